"""Queries of the operators in this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillscope.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.consensus import consensus

    return consensus(read(spark, d, "judge_results")).items.select("receipt_id", "label")


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.consensus import consensus

    return consensus(read(spark, d, "judge_results")).annotators


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.consensus import consensus

    return consensus(read(spark, d, "judge_results")).items.select("receipt_id", "label", "n_votes", "agreement")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.vocabulary import map_flags

    return map_flags(read(spark, d, "judge_results"), read(spark, d, "flag_catalog"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.names import pairs

    return pairs(read(spark, d, "ocr_structured"))


def p4_companies(spark: SparkSession, d: str) -> DataFrame:
    """One row for every row that shows a name, with its company and its number of links."""
    from tillscope.llm.names import companies

    return companies(read(spark, d, "ocr_structured"), with_links=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.pairs import defects

    return defects(read(spark, d, "judge_results"), read(spark, d, "judge_prompts"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.tokenizer import encode

    return encode(read(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.contamination import leaks

    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from tillscope.llm.sentences import sentences

    return sentences(read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_items": p1_items, "p1_annotators": p1_annotators, "p3_found": p3_found, "p4_found": p4_found, "p4_companies": p4_companies, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
SQL: dict[str, str] = {}
