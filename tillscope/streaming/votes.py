"""Structured Streaming: verdict counts as judge answers arrive, and answer sessions per judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_votes(stream: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Votes per receipt and event-time window; rows later than the watermark are dropped.

    ``stream``: result_id, receipt_id, judge_id, label, judged_at and, if it has one, attempt. Of a judge's answers the
    last stands, as in a table: the one of greatest attempt, time and result_id. Redeliveries count once. The state of
    a receipt is its distinct answers in the window, some for each judge.
    """
    last = ["attempt", "judged_at", "result_id"] if "attempt" in stream.columns else ["judged_at", "result_id"]
    d = stream.withWatermark("judged_at", late).where("receipt_id is not null and judge_id is not null")
    answer = F.struct("judge_id", F.struct(*last).alias("o"), F.upper(F.trim("label")).alias("label"))
    g = d.groupBy(F.window("judged_at", window), "receipt_id").agg(F.collect_set(answer).alias("all"))
    votes = F.filter("all", lambda a: ~F.exists("all", lambda b: (b["judge_id"] == a["judge_id"]) & (b["o"] > a["o"])))
    n = lambda x: F.size(F.filter("votes", lambda a: a["label"] == x)).cast("long")
    g = g.withColumn("votes", votes)
    return g.select("window", "receipt_id", F.size("votes").cast("long").alias("n"), n("FAKE").alias("fake"), n("REAL").alias("real"), n("UNCERTAIN").alias("uncertain"))


def judge_sessions(df: DataFrame, gap: str = "30 minutes", late: str = "30 days") -> DataFrame:
    """Sessions of a judge's answers with at most ``gap`` between two; for streams and tables alike."""
    d = df.withWatermark("judged_at", late) if df.isStreaming else df
    g = d.where("judge_id is not null").groupBy("judge_id", F.session_window("judged_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("judge_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
