"""Reproducible stratified sampling by hash rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, sizes: dict[str, int], seed: int = 42, id_col: str = "id", label_col: str = "label", strict: bool = True) -> DataFrame:
    """``sizes[label]`` rows of each label, in the order of md5(seed, id); the same for the same ids, however they lie.

    With ``strict`` a label that has too few rows is an error. Null ids and labels are never drawn. A label with a third
    of all rows is cut by a limit per task before its few rows are ranked (rank limits are pushed below the shuffle).
    """
    ids = df.where(F.col(id_col).isNotNull())
    if strict:
        have = {r[0]: r[1] for r in ids.where(F.col(label_col).isin(list(sizes))).groupBy(label_col).count().collect()}
        for label, k in sizes.items():
            if have.get(label, 0) < k:
                raise ValueError(f"Not enough {label} receipts: {have.get(label, 0)} < {k}")
    rank = F.row_number().over(Window.partitionBy(label_col).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col))), F.col(id_col)))
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    top = ids.where(F.col(label_col).isin(list(sizes))).withColumn("_r", rank).where(F.col("_r") <= max(sizes.values()))
    return top.where(F.col("_r") <= F.element_at(want, F.col(label_col))).drop("_r")


def shuffled(df: DataFrame, seed: int = 43, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col))), id_col)


def sample_document(sample: DataFrame, seed: int, split: str) -> DataFrame:
    """One row: the envelope with counts and the list of receipts. The sample is as small as its sizes say."""
    entry = F.struct(*[c for c in ("id", "label", "split", "image_path", "ocr_txt_path") if c in sample.columns])
    return sample.agg(
        F.lit(seed).alias("random_seed"), F.lit(split).alias("split"), F.count("*").alias("total"), F.count_if(F.col("label") == "REAL").alias("real_count"),
        F.count_if(F.col("label") == "FAKE").alias("fake_count"), F.array_sort(F.collect_list(entry)).alias("receipts"),
    )


def last_entries(entries: DataFrame, id_col: str = "id", order_col: str = "row_pos") -> DataFrame:
    """The last row of every id; rows without an id are none."""
    rest = [c for c in entries.columns if c != id_col]
    return entries.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*rest), order_col).alias("_e")).select(id_col, "_e.*")
