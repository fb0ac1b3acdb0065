"""Verdicts against ground truth: confusion, summary, disagreements, per-judge and per-flag reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.forensics import quantiles


def with_truth(verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds gt: the given label of the receipt, else the embedded ground_truth; rows without either are dropped.

    ``truth``: receipt_id (unique), gt_label. Both sides are hashed on the receipt.
    """
    embedded = F.col("ground_truth") if "ground_truth" in verdicts.columns else F.lit(None).cast("string")
    return verdicts.join(truth, "receipt_id", "left").withColumn("gt", F.coalesce("gt_label", embedded)).drop("gt_label").where("gt is not null")


def last_truth(entries: DataFrame) -> DataFrame:
    """(receipt_id, gt_label) from sample entries: the last row of a receipt is the valid one; null labels are none."""
    last = entries.groupBy(F.col("id").alias("receipt_id")).agg(F.max_by("label", "row_pos").alias("gt_label"))
    return last.withColumn("gt_label", F.upper(F.trim("gt_label"))).where("receipt_id is not null and gt_label is not null")


def summary(judged: DataFrame) -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1 of FAKE. UNCERTAIN is wrong, but no predicted label."""
    one = lambda p, g: F.count_if((F.col("label") == p) & (F.col("gt") == g))
    c = judged.agg(
        one("FAKE", "FAKE").alias("tp"), one("REAL", "REAL").alias("tn"), one("FAKE", "REAL").alias("fp"), one("REAL", "FAKE").alias("fn"),
        F.count_if(F.col("label") == "UNCERTAIN").alias("uncertain"), F.count_if(F.col("label") == F.col("gt")).alias("correct"), F.count("*").alias("rows"),
    )
    c = c.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return c.select(
        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("uncertain")).alias("total_evaluated"), F.round(F.col("correct") / F.greatest("rows", F.lit(1)), 4).alias("accuracy"),
        F.round("precision", 4).alias("precision_fake"), F.round("recall", 4).alias("recall_fake"), F.round(f1, 4).alias("f1_fake"), "tp", "tn", "fp", "fn", "uncertain",
    )


def confusion_map(judged: DataFrame) -> DataFrame:
    """One row with the map of non-zero counts."""
    s = summary(judged)
    m = F.create_map(*[x for k, c in (("TP", "tp"), ("TN", "tn"), ("FP", "fp"), ("FN", "fn"), ("UNCERTAIN", "uncertain")) for x in (F.lit(k), F.col(c))])
    return s.select(F.map_filter(m, lambda k, v: v > 0).alias("confusion_matrix"))


def disagreements(votes: DataFrame, n: int | None = None) -> DataFrame:
    """Receipts with at least two votes and more than one label, by receipt_id; the first n if given."""
    g = votes.groupBy("receipt_id").agg(F.count("*").alias("n_votes"), F.count_distinct("label").alias("n_labels")).where("n_votes >= 2 and n_labels > 1")
    return g.orderBy("receipt_id").limit(n) if n is not None else g


def flag_frequency(df: DataFrame, flags_col: str = "flags") -> DataFrame:
    return df.select(F.explode(flags_col).alias("flag")).where("flag is not null").groupBy("flag").agg(F.count("*").alias("n"))


def per_judge(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy and vote mix of each judge over receipts with a known label."""
    d = votes.join(truth, "receipt_id")
    mix = [F.count_if(F.col("label") == x).alias(x.lower()) for x in ("REAL", "FAKE", "UNCERTAIN")]
    return d.groupBy("judge_id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("gt_label")).cast("double")).alias("accuracy"), *mix)


def histogram(df: DataFrame, value: str, by: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins of 0..1, the last one closed."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))


def uncertainty_matrix(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Receipts by judges: each judge's mean uncertainty, null where it gave no vote."""
    return votes.groupBy("receipt_id").pivot("judge_id", judges).agg(F.avg("u"))


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of each group; the quartiles are exact for groups of any size."""
    g = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumnRenamed(by, "_g")
    return g.join(q, F.col(by).eqNullSafe(F.col("_g")), "left").drop("_g")


def label_counts(entries: DataFrame) -> DataFrame:
    """Rows of each split and label; what is missing counts as none."""
    known = lambda c: F.coalesce(c, F.lit("none"))
    return entries.groupBy(known(F.col("split")).alias("split"), known(F.upper(F.trim("label"))).alias("label")).agg(F.count("*").alias("n"))


def confusion(judged: DataFrame) -> DataFrame:
    """Receipts of each predicted and true label."""
    return judged.groupBy(F.col("label").alias("predicted"), "gt").agg(F.count("*").alias("n"))


def by_correctness(judged: DataFrame, value: str) -> DataFrame:
    """Receipts and the mean of a value, of right and wrong verdicts."""
    return judged.groupBy((F.col("label") == F.col("gt")).alias("correct")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def mean_seconds(df: DataFrame, start: str, end: str, by: str = "receipt_id") -> DataFrame:
    """One row: the mean over receipts of the seconds between the earliest start and the latest end; receipts without both are left out."""
    g = df.groupBy(by).agg(F.min(start).alias("a"), F.max(end).alias("b")).where(F.col(by).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    return g.agg(F.count("*").alias("n"), F.avg((F.unix_micros("b") - F.unix_micros("a")) / 1e6).alias("seconds"))
