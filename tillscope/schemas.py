"""Domains, configurations and schemas shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The domains of judge answers.
LABELS = ["REAL", "FAKE", "UNCERTAIN"]
SKILL_RESULTS = ["pass", "fail", "uncertain"]
RISKS = ["low", "medium", "high"]
MODES = ["GRAPHIC", "READING", "FULL"]
SPLITS = ["train", "val", "test"]
#: The skills, in order.
SKILLS = ["math_consistency", "typography_analysis", "visual_authenticity", "layout_structure", "contextual_validation"]
#: The approved flags.
FLAGS = [
    "TOTAL_MISMATCH", "TAX_ERROR", "LINE_ITEM_ERROR", "FONT_INCONSISTENCY", "TEXT_OVERLAY", "COPY_PASTE_ARTIFACT",
    "COMPRESSION_ANOMALY", "MISSING_FIELDS", "TEMPLATE_LAYOUT", "IMPLAUSIBLE_DATE", "IMPLAUSIBLE_STORE",
    "CURRENCY_MISMATCH", "PAYMENT_INCONSISTENCY", "ERASED_CONTENT", "RESOLUTION_MISMATCH", "SUSPICIOUS_ROUND_TOTAL",
]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


@dataclass(frozen=True)
class ParseConfig:
    """Limits and tolerances of reading a receipt's text."""

    max_cleaned_chars: int = 4000
    max_lines_for_company: int = 8
    max_company_lines: int = 5
    max_date_candidates: int = 8
    max_total_candidates: int = 12
    max_item_candidates: int = 30
    max_amounts: int = 40
    max_amounts_per_line: int = 6
    tolerance_abs: str = "0.10"
    tolerance_pct: str = "10"
    min_ref_for_pct: str = "1.00"
    amount_policy: str = "rightmost"  # or "largest"
    strict_tol_abs: str = "0.02"
    strict_tol_pct: str | None = None
    #: False repairs the reading of ungrouped amounts of 1000 and more.
    compat: bool = True


MONEY = T.StructType([T.StructField("raw", T.StringType()), T.StructField("value", T.DecimalType(18, 3)), T.StructField("currency", T.StringType())])
SAMPLE_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "label", "split", "image_path", "ocr_txt_path")])
JUDGE_RESULT = T.StructType([
    T.StructField("judge_id", T.StringType()), T.StructField("judge_name", T.StringType()), T.StructField("receipt_id", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("skill_results", T.MapType(T.StringType(), T.StringType())), T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("risk_level", T.StringType()), T.StructField("raw_response", T.StringType()), T.StructField("parse_error", T.StringType()),
])
VERDICT = T.StructType([
    T.StructField("receipt_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("tally", T.StringType()),
    T.StructField("vote_counts", T.MapType(T.StringType(), T.LongType())), T.StructField("avg_confidence", T.DoubleType()),
    T.StructField("verdict_uncertainty", T.DoubleType()), T.StructField("strategy_used", T.StringType()),
    T.StructField("all_flags", T.ArrayType(T.StringType())), T.StructField("judge_uncertainties", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("judges", T.ArrayType(JUDGE_RESULT)), T.StructField("ground_truth", T.StringType()),
])
