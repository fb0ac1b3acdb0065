"""Votes of judges per receipt to a verdict with uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def judge_uncertainty(digits: int | None = 4) -> Column:
    """0..1 from label, confidence (0..100), skill_results and risk_level. UNCERTAIN is 1."""
    c = F.col("confidence") / 100.0
    u_conf = F.when(c >= 0.75, 1 - c).otherwise(F.least(F.lit(1.0), 0.25 + (0.75 - c)))
    unsure = F.size(F.map_filter("skill_results", lambda k, v: v == "uncertain"))
    u_skill = unsure / F.greatest(F.size("skill_results"), F.lit(1))
    clash = ((F.col("label") == "FAKE") & (F.col("risk_level") == "low")) | ((F.col("label") == "REAL") & (F.col("risk_level") == "high"))
    u = 0.55 * u_conf + 0.35 * u_skill + F.when(clash, 0.12).otherwise(0.0)
    return F.when(F.col("label") == "UNCERTAIN", 1.0).otherwise(_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), u)), digits))


def winner(fake: Column, real: Column, uncertain: Column, n: Column, threshold: int = 2) -> tuple[Column, Column]:
    """(label, strategy): enough UNCERTAIN votes first, then a majority, else UNCERTAIN."""
    need = F.floor(n / 2) + 1
    label = F.when(uncertain >= threshold, "UNCERTAIN").when(fake >= need, "FAKE").when(real >= need, "REAL").otherwise("UNCERTAIN")
    how = F.when(uncertain >= threshold, "majority_simple (uncertain threshold)").when((fake >= need) | (real >= need), "majority_simple").otherwise("majority_simple (no majority)")
    return label, how


def vote_all(receipts: DataFrame, results: DataFrame, **kw) -> DataFrame:
    """``vote`` for every receipt_id of ``receipts``; one that has no vote at all is an error when its row is made."""
    v = vote(results, **kw)
    d = receipts.select("receipt_id").distinct().join(v, "receipt_id", "left")
    missing = F.raise_error(F.concat(F.lit("no votes for receipt "), F.col("receipt_id"))).cast("string")
    return d.withColumn("label", F.when(F.col("n").isNull(), missing).otherwise(F.col("label")))


def vote(results: DataFrame, order_col: str = "result_id", threshold: int = 2, digits: int | None = 4) -> DataFrame:
    """One verdict per receipt_id from (receipt_id, judge_id, label, confidence, skill_results, flags, risk_level).

    Flags keep the order of judges and of each judge's list. A judge_id that occurs twice counts twice as a vote but
    once, with its last row, in the mean uncertainty. Null labels and confidences count as UNCERTAIN and 0. A receipt's
    votes are as many as its judges; counts are partial aggregates and only flags and uncertainties are gathered.
    """
    d = results.where("receipt_id is not null").withColumns({"label": F.coalesce("label", F.lit("UNCERTAIN")), "confidence": F.coalesce("confidence", F.lit(0.0)), "skill_results": F.coalesce("skill_results", F.create_map().cast("map<string,string>"))})
    d = d.withColumn("u", judge_uncertainty(digits))
    n = lambda label: F.count_if(F.col("label") == label)
    lists = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.coalesce("flags", F.array().cast("array<string>")).alias("f"))))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("judge_id").alias("j"), F.col("u").alias("u"))))
    g = d.groupBy("receipt_id").agg(F.count("*").alias("n"), n("FAKE").alias("fake"), n("REAL").alias("real"), n("UNCERTAIN").alias("uncertain"), F.avg("confidence").alias("avg_confidence"), lists.alias("lists"), pairs.alias("pairs"))
    label, how = winner(F.col("fake"), F.col("real"), F.col("uncertain"), F.col("n"), threshold)
    g = g.withColumns({"label": label, "strategy_used": how})
    won = F.when(F.col("label") == "FAKE", F.col("fake")).when(F.col("label") == "REAL", F.col("real")).otherwise(F.col("uncertain"))
    # Of a judge's rows the last one stands.
    last = F.filter("pairs", lambda p: ~F.exists("pairs", lambda q: (q["j"] == p["j"]) & (q["o"] > p["o"])))
    us = F.map_from_entries(F.transform(last, lambda p: F.struct(p["j"], p["u"])))
    mean = F.aggregate(last, F.lit(0.0), lambda a, p: a + p["u"]) / F.greatest(F.size(last), F.lit(1))
    against = F.when(F.col("label") == "FAKE", F.col("real")).when(F.col("label") == "REAL", F.col("fake")).otherwise(F.col("fake") + F.col("real"))
    counts = F.map_filter(F.create_map(F.lit("FAKE"), F.col("fake"), F.lit("REAL"), F.col("real"), F.lit("UNCERTAIN"), F.col("uncertain")), lambda k, v: v > 0)
    return g.select(
        "receipt_id", "label", F.format_string("%s (%d/%d)", "label", won, "n").alias("tally"), counts.alias("vote_counts"), "avg_confidence",
        _round(F.least(F.lit(1.0), 0.5 * against / F.col("n") + 0.5 * mean), digits).alias("verdict_uncertainty"), "strategy_used",
        F.array_distinct(F.flatten(F.transform("lists", lambda x: x["f"]))).alias("all_flags"), us.alias("judge_uncertainties"), "n",
    )
