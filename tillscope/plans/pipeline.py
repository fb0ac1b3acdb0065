"""The whole run as one façade: sample, evidence, prompts, calls, verdicts, evaluation. All methods are lazy."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.operators import audit, evaluate, judging, sampling, voting
from tillscope.operators.imaging import analyzers
from tillscope.schemas import ParseConfig
from tillscope.sources import sinks
from tillscope.session import build_session


class ReceiptAudit:
    def __init__(self, spark: SparkSession, judges: DataFrame, make_client: Callable[[], judging.Client] = judging.RuleJudge, cfg: ParseConfig = ParseConfig(), threshold: int = 2):
        self.spark, self.judges, self.make_client, self.cfg, self.threshold = spark, judges, make_client, cfg, threshold

    def sample(self, labels: DataFrame, n_real: int = 10, n_fake: int = 10, seed: int = 42) -> DataFrame:
        picked = sampling.stratified(labels, {"REAL": n_real, "FAKE": n_fake}, seed, "receipt_id")
        return sampling.shuffled(picked, seed + 1, "receipt_id")

    def evidence(self, receipts: DataFrame, mode: str = "FULL") -> DataFrame:
        """receipts: receipt_id, text and, for GRAPHIC and FULL, image (and content, its file's bytes). A part that fails is an error in its struct."""
        d = receipts
        if mode != "GRAPHIC":
            d = judging.rule_flags(audit.audit(d, "text", self.cfg))
        if mode != "READING" and "image" in d.columns:
            d = analyzers.features(d, mode)
        return d.withColumn("evidence", F.to_json(analyzers.evidence(d, mode))).withColumn("mode", F.lit(mode))

    def judge(self, receipts: DataFrame) -> DataFrame:
        """Every receipt by every judge, with the evidence of the judge's mode; each mode's evidence is made once."""
        keep = ["receipt_id", "mode", "evidence"]
        modes = [m for m in ("READING", "GRAPHIC", "FULL") if m == "READING" or "image" in receipts.columns]
        read = self.evidence(receipts, "READING")
        packs = read.select(*keep)
        for m in modes[1:]:
            packs = packs.unionByName(self.evidence(receipts, m).select(*keep))
        if "image" not in receipts.columns:  # without images every judge reads
            packs = packs.select("receipt_id", F.explode(F.array(*[F.lit(m) for m in ("READING", "GRAPHIC", "FULL")])).alias("mode"), "evidence")
        asked = judging.prompts(packs, self.judges).join(read.select("receipt_id", "rule_flags", "arithmetic_consistent"), "receipt_id")
        called = judging.call_judges(asked, self.make_client)
        return judging.parse_responses(called).withColumn("result_id", F.xxhash64("receipt_id", "judge_id"))

    def verdicts(self, results: DataFrame) -> DataFrame:
        return voting.vote(results, threshold=self.threshold)

    def evaluate(self, verdicts: DataFrame, truth: DataFrame) -> DataFrame:
        return evaluate.summary(evaluate.with_truth(verdicts, truth))

    def run(self, receipts: DataFrame, path: str, existing: DataFrame | None = None) -> None:
        """Judge the receipts that have no verdict yet and append theirs."""
        new = receipts if existing is None else receipts.join(existing.select("receipt_id"), "receipt_id", "left_anti")
        sinks.write_missing(self.verdicts(self.judge(new)), None, path)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tillscope")
    p.add_argument("command", choices=["query", "list", "run"])
    p.add_argument("--name", help="query to run")
    p.add_argument("--data", help="folder with the tables")
    p.add_argument("--out", help="folder for the result; without it twenty rows are shown")
    a = p.parse_args(argv)
    from tillscope.plans.queries import QUERIES

    if a.command == "list":
        print("\n".join(QUERIES))
        return
    spark = build_session()
    if a.command == "run":
        ocr = spark.read.parquet(f"{a.data}/ocr_structured.parquet").where("receipt_id is not null")
        receipts = ocr.groupBy("receipt_id").agg(F.max_by("cleaned_text", F.struct("quality_score", "ocr_id")).alias("text"))
        ReceiptAudit(spark, spark.read.parquet(f"{a.data}/judge_config.parquet")).run(receipts, a.out)
        return
    df = QUERIES[a.name](spark, a.data)
    df.show(20, False) if a.out is None else df.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
