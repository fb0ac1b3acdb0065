"""Judge stage: prompts per receipt and judge, the model call, and parsing of raw responses.

The call itself is an injected client; everything around it is relational. A client that needs no network, ``RuleJudge``,
judges by the computable rules of the audit.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.text import strip
from tillscope.schemas import FLAGS, LABELS, RISKS, SKILL_RESULTS, SKILLS
from tillscope.session import staged

#: The reasons of a failed row.
ERROR_REASONS = ["Failed to parse judge response", "Judge returned invalid schema"]
SKILL_TEXT = {
    "math_consistency": "Recompute line totals, subtotal, tax and total, and payment less change.",
    "typography_analysis": "Compare typefaces, sizes and spacing of letters and digits.",
    "visual_authenticity": "Look for pasted, erased or overlaid regions and uneven sharpness.",
    "layout_structure": "Check the order of header, items, totals, payment and footer.",
    "contextual_validation": "Check date, shop, currency and payment method for plausibility.",
}


def extract_json(raw: Column) -> Column:
    """Fences off; from the first brace to the last, else the text."""
    s = strip(F.regexp_replace(raw, r"```(?:json)?", ""))
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(s)


def coerce_label(label: Column) -> Column:
    up = F.upper(label)
    return F.when(up.isin(LABELS), up).otherwise("UNCERTAIN")


def coerce_confidence(c: Column) -> Column:
    """Clamped to 0..100; NaN becomes 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


#: Fixed value: what fills up a list of reasons.
NO_REASON = "No reason provided"


def coerce_reasons(reasons: Column) -> Column:
    four = F.slice(F.coalesce(reasons, F.array().cast("array<string>")), 1, 4)
    return F.concat(four, F.array_repeat(F.lit(NO_REASON), F.greatest(F.lit(0), 2 - F.size(four))))


def coerce_skills(skills: Column) -> Column:
    """The old key typography is renamed; missing or invalid canonical skills are uncertain; other keys stay."""
    m = F.coalesce(skills, F.create_map().cast("map<string,string>"))
    value = lambda k: F.coalesce(F.element_at(m, k), F.element_at(m, "typography")) if k == "typography_analysis" else F.element_at(m, k)
    canon = F.create_map(*[x for k in SKILLS for x in (F.lit(k), F.when(value(k).isin(SKILL_RESULTS), value(k)).otherwise("uncertain"))])
    renamed = ~F.map_contains_key(m, F.lit("typography_analysis"))
    extra = F.map_filter(m, lambda k, v: ~k.isin(SKILLS) & ~((k == "typography") & renamed))
    return F.map_concat(canon, extra)


def keep_approved(flags: Column) -> Column:
    return F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.isin(FLAGS))


def coerce_risk(risk: Column) -> Column:
    low = F.lower(risk)
    return F.when(low.isin(RISKS), low).otherwise("low")


def is_valid(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return c("label").isin(LABELS) & c("confidence").between(0, 100) & F.size(c("reasons")).between(2, 4) & c("risk_level").isin(RISKS)


def parse_responses(df: DataFrame, raw_col: str = "raw_response") -> DataFrame:
    """Adds label, confidence, reasons, skill_results, flags, risk_level and parse_error, read from the raw text.

    A text that is no JSON object, or null, gives the failed row: UNCERTAIN, 0, two fixed reasons, all skills uncertain.
    So does a confidence that is no number. Existing columns of these names are replaced.
    """
    out = ["label", "confidence", "reasons", "skill_results", "flags", "risk_level", "parse_error"]
    d = staged(df.drop(*[c for c in out if c in df.columns and c != raw_col]), _v=F.try_parse_json(extract_json(F.col(raw_col))))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    given = get("$.confidence", "string")
    number = get("$.confidence", "double")
    ok = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)) & (given.isNull() | number.isNotNull())
    listed = F.coalesce(get("$.reasons", "array<string>"), F.when(get("$.reasons", "string").isNotNull(), F.array(get("$.reasons", "string"))))
    failed = lambda good, bad: F.when(F.col("_ok"), good).otherwise(bad)
    d = staged(d, _ok=ok)
    d = staged(
        d,
        label=failed(coerce_label(F.coalesce(get("$.label", "string"), F.lit("UNCERTAIN"))), F.lit("UNCERTAIN")),
        confidence=failed(coerce_confidence(F.coalesce(number, F.lit(0.0))), F.lit(0.0)),
        reasons=failed(coerce_reasons(listed), F.array(*[F.lit(r) for r in ERROR_REASONS])),
        skill_results=coerce_skills(F.when(F.col("_ok"), get("$.skill_results", "map<string,string>"))),
        flags=failed(keep_approved(get("$.flags", "array<string>")), F.array().cast("array<string>")),
        risk_level=failed(coerce_risk(F.coalesce(get("$.risk_level", "string"), F.lit("low"))), F.lit("low")),
        parse_error=F.when(~F.col("_ok"), F.lit("JSON decode error")),
    )
    return d.drop("_v", "_ok")


def normalise_skills(selected: Column) -> Column:
    """Canonical order, once each; null selects all. Unknown or empty selections are errors (raise at run time)."""
    known = F.filter(F.array(*[F.lit(s) for s in SKILLS]), lambda c: selected.isNull() | F.array_contains(selected, c))
    unknown = F.size(F.array_except(selected, F.array(*[F.lit(s) for s in SKILLS])))
    bad = selected.isNotNull() & ((unknown > 0) | (F.size(selected) == 0))
    return F.when(bad, F.raise_error(F.lit("unknown or empty skills")).cast("array<string>")).otherwise(known)


def skills_block(skills: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in SKILL_TEXT.items() for x in kv])
    parts = F.transform(skills, lambda s, i: F.concat(F.lit("#### "), (i + 1).cast("string"), F.lit(". "), s, F.lit("\n"), F.element_at(texts, s)))
    return F.array_join(parts, "\n\n---\n\n")


def skill_text(markdown: str, where: str) -> str:
    """A skill's text for ``skills_block``: it stands below a heading of level 3, so it may hold none of levels 1 to 3."""
    if re.search(r"^#{1,3}\s", markdown, re.MULTILINE):
        raise ValueError(f"heading of level 3 or less in {where}")
    return markdown.strip()


def with_constraint(system: str, skills: list[str]) -> str:
    """A system prompt whose fourth rule, if it speaks of skill_results, names the skills that are asked for."""
    rule = f'4. `"skill_results"` holds one of {", ".join(SKILL_RESULTS)} for each of these {len(skills)}: {", ".join(skills)}.'
    return re.sub(r'^[ \t]*4\.[ \t].*"skill_results".*$', lambda _: rule, system, count=1, flags=re.MULTILINE)


def output_schema(skills: list[str] | None = None) -> str:
    """The JSON shape that a judge is asked for, with only its skills."""
    use = [s for s in SKILLS if skills is None or s in skills]
    return json.dumps({"label": "|".join(LABELS), "confidence": "0-100", "reasons": ["2 to 4 strings"], "skill_results": dict.fromkeys(use, "|".join(SKILL_RESULTS)), "flags": FLAGS, "risk_level": "|".join(RISKS)})


def prompts(evidence: DataFrame, judges: DataFrame, max_judges: int = 10_000) -> DataFrame:
    """One row per receipt and judge with its prompt: judges take the evidence of their mode.

    ``evidence``: receipt_id, mode, evidence (JSON text), computed once per distinct mode. The judges are a small side
    of checked size; more than ``max_judges`` are joined by shuffle.
    """
    j = judges.select("judge_id", "judge_name", F.col("forensic_mode").alias("mode"), normalise_skills(F.col("focus_skills")).alias("skills"))
    if j.limit(max_judges + 1).count() <= max_judges:
        j = F.broadcast(j)
    d = evidence.join(j, "mode")
    asked = F.concat(F.lit('{"label": ..., "confidence": ..., "reasons": [...], "skill_results": {'), F.array_join("skills", ": ..., "), F.lit(': ...}, "flags": [...], "risk_level": ...}'))
    text = F.concat_ws("\n\n", F.concat(F.lit("You are "), "judge_name", F.lit(". Decide whether the receipt is REAL, FAKE or UNCERTAIN.")), skills_block(F.col("skills")), F.concat(F.lit("### Evidence ("), "mode", F.lit(")\n"), "evidence"), F.concat(F.lit("### Answer with one JSON object\n"), asked))
    return d.select("receipt_id", "judge_id", "judge_name", "mode", "skills", text.alias("prompt"))


Client = Callable[[dict], str]


def message(prompt: Column, images: Column, persona: Column | None = None, images_first: bool = True) -> Column:
    """The JSON messages of a chat request: images (data URLs) before or after the text, the persona as system message."""
    parts = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")))
    text = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")))
    user = F.to_json(F.struct(F.lit("user").alias("role"), (F.concat(parts, text) if images_first else F.concat(text, parts)).alias("content")))
    if persona is None:
        return F.concat(F.lit("["), user, F.lit("]"))
    return F.concat(F.lit("["), F.to_json(F.struct(F.lit("system").alias("role"), persona.alias("content"))), F.lit(","), user, F.lit("]"))


#: Clients by a word that a model's name contains; the last is the default. Network clients are registered by the caller.
CLIENTS: dict[str, Callable[[], Client]] = {}


def presets(spark: SparkSession) -> DataFrame:
    """The two judges that are there without a configuration, in its columns."""
    #: Names, temperatures, skills and modes.
    rows = [
        ("judge_1", "Forensic Accountant", 0.2, 1024, ["math_consistency", "contextual_validation"], "READING"),
        ("judge_2", "Document Examiner", 0.6, 1024, ["typography_analysis", "visual_authenticity", "layout_structure"], "GRAPHIC"),
    ]
    return spark.createDataFrame(rows, "judge_id string, judge_name string, temperature double, max_tokens int, focus_skills array<string>, forensic_mode string")


def acceptable(raw: str | None) -> bool:
    """Whether an answer need not be asked for again: it parses, or it is no JSON object at all and gives the failed row.

    A JSON object with a confidence that is no number, with skills that are no object or flags that are null is asked for again.
    """
    body = re.sub(r"```(?:json)?", "", raw or "").strip()
    found = re.search(r"\{.*\}", body, re.DOTALL)
    try:
        answer = json.loads(found.group(0) if found else body)
    except ValueError:
        return True
    if not isinstance(answer, dict):
        return True
    try:
        float(answer.get("confidence", 0.0))
    except (TypeError, ValueError):
        return False
    return isinstance(answer.get("skill_results", {}), dict) and isinstance(answer.get("flags", []), list)


def client_for(model: str) -> Callable[[], Client]:
    return next((make for word, make in CLIENTS.items() if word in model), RuleJudge)


#: The supporting pictures that a visual judge may see, in order.
SUPPORTING = ["mela/mela_heat.png", "mela/mela_overlay.png", "mela/mela_rois.png", "noise/noise_overlay.png", "noise/noise_heat.png", "copymove/copymove_rois.png"]


def supporting_images(mode: Column, present: Column) -> Column:
    """The artifacts that exist, in the fixed order; none for READING."""
    wanted = F.filter(F.array(*[F.lit(s) for s in SUPPORTING]), lambda s: F.array_contains(present, s))
    return F.when(mode.isin("GRAPHIC", "FULL"), wanted).otherwise(F.array().cast("array<string>"))


def call_judges(rows: DataFrame, make_client: Callable[[], Client], max_attempts: int = 3, accept: Callable[[str | None], bool] = acceptable, at_once: int = 1, wait: float = 0.0) -> DataFrame:
    """Adds raw_response, attempts and call_error by calling the client per row, until an answer is acceptable.

    The client is built once per task and called ``at_once`` times side by side, which it must allow. It must be
    idempotent, since a task may be run again. Before the n-th further try ``wait`` x 2^(n-1) seconds pass. A row without
    any acceptable answer keeps null and the last error.
    """

    def ask(client: Client, row: dict) -> tuple[str | None, int, str | None]:
        error = None
        for n in range(1, max_attempts + 1):
            if n > 1 and wait:
                time.sleep(wait * 2 ** (n - 2))
            try:
                raw = client(row)
                if accept(raw):
                    return raw, n, None
                error = "Max retries exceeded. Last error: invalid answer"
            except Exception as e:  # noqa: BLE001
                error = f"Max retries exceeded. Last error: {e}"
        return None, max_attempts, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                got = list(pool.map(lambda row: ask(client, row), pdf.to_dict("records")))
                yield pdf.assign(raw_response=[g[0] for g in got], attempts=[g[1] for g in got], call_error=[g[2] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, raw_response string, attempts int, call_error string")


@dataclass(frozen=True)
class RuleJudge:
    """An offline client: one strong rule makes FAKE, none REAL, only unknown ones UNCERTAIN. Rules are our own."""

    def __call__(self, row: dict) -> str:
        fired = [f for f in (row.get("rule_flags") if row.get("rule_flags") is not None else [])]
        known = row.get("arithmetic_consistent")
        label = "FAKE" if fired else "UNCERTAIN" if known is None else "REAL"
        reasons = [f"Rule {f} holds." for f in fired[:4]] or ["No computable rule is broken.", "The arithmetic was checked."]
        reasons += [NO_REASON] * (2 - len(reasons))
        skills = {s: "uncertain" for s in SKILLS} | {"math_consistency": "uncertain" if known is None else "pass" if known else "fail"}
        return json.dumps({"label": label, "confidence": 85.0 if fired else 70.0 if known else 40.0, "reasons": reasons, "skill_results": skills, "flags": fired, "risk_level": "high" if fired else "low"})


def rule_flags(audited: DataFrame) -> DataFrame:
    """Adds rule_flags: the computable rubric rules that an audited receipt breaks, as approved flags."""
    rows = F.col("lines")
    tagged = lambda tag: F.filter(rows, lambda r: F.array_contains(r["keywords"], tag))
    cents = F.exists(F.filter(rows, lambda r: (F.size(r["money"]) > 0) & (F.size(r["keywords"]) == 0)), lambda r: F.element_at(r["money"], -1)["value"] % 1 != 0)
    norms = F.transform(rows, lambda r: r["norm"])
    currencies = F.array_distinct(F.filter(F.flatten(F.transform(rows, lambda r: F.transform(r["money"], lambda m: m["currency"]))), lambda c: c.isNotNull()))
    rate = F.round(F.col("tax") / F.col("subtotal"), 2)
    #: The usual tax rates.
    usual = [0.05, 0.06, 0.07, 0.08, 0.09, 0.10, 0.12, 0.15, 0.18, 0.20, 0.23, 0.25]
    last_total = F.array_max(F.transform(tagged("TOTAL"), lambda r: r["idx"]))
    first_paid = F.array_min(F.transform(tagged("PAID"), lambda r: r["idx"]))
    rules = [
        ("TOTAL_MISMATCH", ~F.col("arithmetic_consistent")),
        ("TAX_ERROR", (F.col("tax") > 0) & (F.col("subtotal") > 0) & ~rate.isin(*usual)),
        ("PAYMENT_INCONSISTENCY", F.abs(F.col("paid") - F.col("change") - F.col("total")) > 0.1),
        ("SUSPICIOUS_ROUND_TOTAL", (F.col("total") >= 10) & (F.col("total") % 10 == 0) & cents),
        ("CURRENCY_MISMATCH", F.size(currencies) > 1),
        ("LINE_ITEM_ERROR", F.size(norms) - F.size(F.array_distinct(norms)) > 2),
        ("MISSING_FIELDS", F.col("total").isNull() | (F.size("date_candidates") == 0)),
        ("TEMPLATE_LAYOUT", first_paid < last_total),
        ("IMPLAUSIBLE_STORE", F.exists("company_lines", lambda c: F.upper(c).rlike("YOUR (STORE|COMPANY|BUSINESS)|SAMPLE|STORE NAME|LOREM"))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(f)) for f, c in rules]), lambda f: f.isNotNull())
    return audited.withColumn("rule_flags", found)
