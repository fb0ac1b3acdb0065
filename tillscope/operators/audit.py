"""Reading receipt text and checking its arithmetic: lines, candidates, amounts, consistency.

``structure`` turns a text into lines with amounts and tags and the candidate lists; ``arithmetic`` and ``semantic``
derive the checks from it. All are row-wise: one receipt is one row and nothing is shuffled. Null texts are read as
empty; repeated receipts are each read; extra columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import text as X
from tillscope.functions.money import line_amount, money_tokens, sorted_amounts
from tillscope.schemas import ParseConfig
from tillscope.session import staged

#: Tag and phrases, most telling first, of each field.
FIELDS = {
    "subtotal": ("SUBTOTAL", ["SUBTOTAL", "SUB TOTAL", "SUB-TOTAL"]),
    "tax": ("TAX", ["GST", "VAT", "TAX", "SST", "IVA", "IGV"]),
    "discount": ("DISCOUNT", ["DISCOUNT", "DISC", "LESS", "PROMO", "COUPON"]),
    "rounding": ("ROUNDING", ["ROUNDING", "ROUND OFF", "ROUNDED", "RND"]),
    "service_charge": ("SERVICE", ["SERVICE CHARGE", "SERVICE", "SVC"]),
    "total": ("TOTAL", ["GRAND TOTAL", "TOTAL DUE", "AMOUNT DUE", "AMOUNT PAYABLE", "BALANCE DUE", "TOTAL", "NETT", "NET", "TO PAY"]),
    "paid": ("PAID", ["TENDERED", "RECEIVED", "CASH", "PAID", "PAYMENT"]),
    "change": ("CHANGE", ["CHANGE", "CASHBACK", "RETURN", "REFUND", "BALANCE"]),
}
#: Patterns and phrases of the strict check's fields.
STRICT = {
    "subtotal": (r"(?i)\b(subtotal|sub total|sub-total)\b", None, ["SUBTOTAL", "SUB TOTAL", "SUB-TOTAL"]),
    "tax": (r"(?i)\b(tax|vat|gst|sst|iva|igv)\b", None, ["GST", "VAT", "TAX", "SST", "IVA", "IGV"]),
    "total": (
        r"(?i)\b(total|amount due|grand total|balance due|amount payable|total due)\b",
        r"(?i)\b(subtotal|sub total|sub-total)\b",
        ["GRAND TOTAL", "TOTAL DUE", "AMOUNT DUE", "AMOUNT PAYABLE", "BALANCE DUE", "TOTAL"],
    ),
}
DEC = "decimal(18,3)"


def _priority(n: Column, phrases: list[str]) -> Column:
    """200 for the first phrase found, 20 less for each later one, 0 for none."""
    return reduce(lambda acc, ip: F.when(F.contains(n, F.lit(ip[1])), 200 - 20 * ip[0]).otherwise(acc), reversed(list(enumerate(phrases))), F.lit(0))


def structure(df: DataFrame, text_col: str = "text", cfg: ParseConfig = ParseConfig()) -> DataFrame:
    """Adds cleaned_text, quality_score, lines (idx, text, norm, money, keywords) and the candidate lists."""
    d = staged(df, _c=X.clean_text(F.coalesce(F.col(text_col), F.lit(""))))
    d = staged(d, _l=X.lines(F.col("_c")))
    d = staged(d, _m=F.transform("_l", lambda x: money_tokens(x, cfg.max_amounts_per_line, cfg.compat)), _n=F.transform("_l", X.norm))
    d = staged(d, _k=F.transform("_n", X.keywords))
    rows = F.transform("_l", lambda x, i: F.struct(i.alias("idx"), x.alias("text"), F.get("_n", i).alias("norm"), F.get("_m", i).alias("money"), F.get("_k", i).alias("keywords")))
    d = staged(d, lines=rows)
    paid = lambda r: F.array_contains(r["keywords"], "PAID") | F.array_contains(r["keywords"], "CHANGE")
    money = F.filter("lines", lambda r: F.size(r["money"]) > 0)
    short = lambda r: F.left(r["text"], F.lit(120))
    total = F.transform(F.filter(money, lambda r: F.size(r["keywords"]) > 0), short)
    item = F.transform(F.filter(money, lambda r: (F.size(r["keywords"]) == 0) & ~X.contains_any(r["norm"], X.COMPANY_STOPWORDS)), short)
    payment = F.transform(F.filter(money, paid), short)
    # Names end at the first line with money or a date that is no header line.
    head = F.filter(F.slice("lines", 1, cfg.max_lines_for_company), lambda r: ~X.contains_any(r["norm"], X.COMPANY_STOPWORDS))
    stop = F.filter(F.transform(head, lambda r, i: F.when((F.size(r["money"]) > 0) | X.has_date(r["text"]), i)), lambda i: i.isNotNull())
    until = F.when(F.size(stop) > 0, F.element_at(stop, 1)).otherwise(F.size(head))
    company = F.transform(F.slice(head, 1, F.least(until, F.lit(cfg.max_company_lines))), lambda r: F.left(r["text"], F.lit(80)))
    d = staged(
        d,
        quality_score=X.quality_score(F.col("_c"), F.col("_l")),
        cleaned_text=F.left("_c", F.lit(cfg.max_cleaned_chars)),
        company_lines=company,
        date_candidates=X.date_candidates(F.col("_l"), cfg.max_date_candidates),
        total_candidates=X.dedupe(total, cfg.max_total_candidates),
        item_candidates=X.dedupe(item, cfg.max_item_candidates),
        payment_candidates=X.dedupe(payment, cfg.max_total_candidates),
        all_amounts=sorted_amounts(F.col("_m"), cfg.max_amounts),
    )
    return d.drop("_c", "_l", "_m", "_n", "_k")


def _best(tag: str, phrases: list[str]) -> Column:
    """The last amount of the best line: highest score, then the later line."""
    fits = F.filter("lines", lambda r: (F.size(r["money"]) > 0) & (F.array_contains(r["keywords"], tag) | X.contains_any(r["norm"], phrases)))
    scored = F.transform(fits, lambda r: F.struct((_priority(r["norm"], phrases) + F.when(F.array_contains(r["keywords"], tag), 50).otherwise(0)).alias("score"), r["idx"].alias("idx"), line_amount(r["money"]).alias("amount")))
    return F.array_max(scored)["amount"]


def tolerance(diff: Column, ref: Column, cfg: ParseConfig) -> tuple[Column, Column]:
    """(passes, percent): within the larger of the tolerances; a small reference allows only the absolute one."""
    ad = F.abs(diff)
    big = ref >= F.lit(cfg.min_ref_for_pct).cast(DEC)
    limit = F.greatest(F.lit(cfg.tolerance_abs).cast("decimal(38,6)"), (ref * F.lit(cfg.tolerance_pct).cast("decimal(6,3)") / 100).cast("decimal(38,6)"))
    passes = F.when(big, ad.cast("decimal(38,6)") <= limit).otherwise(ad <= F.lit(cfg.tolerance_abs).cast(DEC))
    percent = F.when(big, F.bround((ad / ref * 100).cast("decimal(28,10)"), 1).cast("double"))
    return passes, percent


def _check(when: Column, name: str, lhs: Column, rhs: Column, diff: Column, cfg: ParseConfig) -> Column:
    passes, percent = tolerance(diff, rhs, cfg)
    return F.when(when, F.struct(F.lit(name).alias("name"), X.money_text(lhs).alias("lhs"), X.money_text(rhs).alias("rhs"), F.round(diff, 2).cast("decimal(18,2)").alias("diff"), percent.alias("diff_pct"), passes.alias("passes")))


def arithmetic(d: DataFrame, cfg: ParseConfig = ParseConfig()) -> DataFrame:
    """Adds the eight fields, item_count, item_sum, checks, arithmetic_consistent and best_explanation."""
    items = F.filter("lines", lambda r: (F.size(r["money"]) > 0) & F.array_contains(F.col("item_candidates"), F.left(r["text"], F.lit(120))))
    amounts = F.transform(items, lambda r: line_amount(r["money"], cfg.amount_policy))
    d = staged(d, _items=amounts, **{f: _best(*v).cast(DEC) for f, v in FIELDS.items()})
    total = F.aggregate("_items", F.lit(0).cast("decimal(28,3)"), lambda a, x: (a + x).cast("decimal(28,3)"))
    d = staged(d, item_count=F.size("_items"), item_sum=F.round(total, 2).cast(DEC)).drop("_items")
    zero = F.lit(0).cast(DEC)
    base = F.coalesce("subtotal", F.when(F.col("item_sum") != 0, F.col("item_sum")))
    d = staged(
        d,
        _expected=F.round(base + F.coalesce("tax", zero) + F.coalesce("service_charge", zero) - F.abs(F.coalesce("discount", zero)) + F.coalesce("rounding", zero), 2).cast(DEC),
        _net=F.round(F.col("paid") - F.col("change"), 2).cast(DEC),
    )
    checks = F.array(
        _check(F.col("subtotal").isNotNull() & (F.col("item_sum") != 0), "items_vs_subtotal", F.col("item_sum"), F.col("subtotal"), F.round(F.col("subtotal") - F.col("item_sum"), 2), cfg),
        _check(F.col("_expected").isNotNull() & F.col("total").isNotNull(), "expected_total_vs_total", F.col("_expected"), F.col("total"), F.round(F.col("total") - F.col("_expected"), 2), cfg),
        _check(F.col("_net").isNotNull() & F.col("total").isNotNull(), "paid_minus_change_vs_total", F.col("_net"), F.col("total"), F.round(F.col("_net") - F.col("total"), 2), cfg),
    )
    d = staged(d, checks=F.filter(checks, lambda c: c.isNotNull())).drop("_expected", "_net")
    passing = F.filter("checks", lambda c: c["passes"])
    best = F.array_min(F.transform(passing, lambda c, i: F.struct(F.abs(c["diff"]).alias("d"), i.alias("i"), c["name"].alias("name"))))
    consistent = F.when(F.size(passing) > 0, True).when(F.size("checks") > 0, False)
    why = F.when(F.size(passing) > 0, best["name"]).when(F.size("checks") > 0, F.element_at("checks", 1)["name"])
    return staged(d, arithmetic_consistent=consistent, best_explanation=why)


def _pick(include: str, exclude: str | None, phrases: list[str]) -> Column:
    """Amount and text of the best line: highest score, then the earlier line."""

    def fits(r: Column) -> Column:
        ok = (F.size(r["money"]) > 0) & r["text"].rlike(include)
        return ok & ~r["text"].rlike(exclude) if exclude else ok

    return F.array_max(F.transform(F.filter("lines", fits), lambda r: F.struct((_priority(r["norm"], phrases) + F.least(r["idx"], F.lit(80))).alias("s"), (-r["idx"]).alias("i"), line_amount(r["money"]).alias("amount"), r["text"].alias("text"))))


def semantic(d: DataFrame, cfg: ParseConfig = ParseConfig()) -> DataFrame:
    """Adds semantic_checks: the strict check of subtotal + tax against total, then the arithmetic checks and verdict."""
    d = staged(d, **{f"_{k}": _pick(*v) for k, v in STRICT.items()})
    sub, tax, total = (F.col(f"_{k}.amount") for k in ("subtotal", "tax", "total"))
    lhs = F.round(sub + tax, 2)
    limit = F.lit(cfg.strict_tol_abs).cast(DEC)
    if cfg.strict_tol_pct is not None:
        limit = F.greatest(limit, F.when(total != 0, F.abs(total) * F.lit(cfg.strict_tol_pct).cast("decimal(8,4)") / 100).otherwise(0))
    have = sub.isNotNull() & tax.isNotNull() & total.isNotNull()
    text = lambda v: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in v.items()]))
    evidence = text({f"{k}_line": X.truncate(F.col(f"_{k}.text"), 160) for k in STRICT})
    said = F.concat(X.money_text(sub), F.lit(" + "), X.money_text(tax), F.lit(" = "), X.money_text(lhs), F.lit(" vs total="), X.money_text(total), F.lit(f" (tol_abs={cfg.strict_tol_abs})"))
    shape = lambda n, p, t, e, v: F.struct(n.alias("name"), p.alias("passed"), t.alias("details"), e.alias("evidence"), v.alias("values"))
    strict = shape(
        F.lit("subtotal+tax≈total_strict"),
        F.when(have, F.abs(lhs - total) <= limit),
        F.when(have, said).otherwise(F.lit("strict check: subtotal, tax or total was not read")),
        evidence,
        text({"subtotal": X.money_text(sub), "tax": X.money_text(tax), "lhs": F.when(have, X.money_text(lhs)), "total": X.money_text(total)}),
    )
    none = F.create_map().cast("map<string,string>")
    arith = F.transform("checks", lambda c: shape(F.concat(F.lit("arith::"), c["name"]), c["passes"], F.concat_ws(" ", F.concat(F.lit("lhs="), c["lhs"]), F.concat(F.lit("rhs="), c["rhs"]), F.concat(F.lit("diff="), c["diff"].cast("string"))), none, text({"lhs": c["lhs"], "rhs": c["rhs"], "diff": c["diff"], "diff_pct": c["diff_pct"]})))
    overall = shape(F.lit("arith::overall"), F.col("arithmetic_consistent"), F.concat(F.lit("best_explanation="), F.coalesce("best_explanation", F.lit("None"))), none, text({"arithmetic_consistent": F.col("arithmetic_consistent"), "best_explanation": F.col("best_explanation")}))
    return staged(d, semantic_checks=F.concat(F.array(strict), arith, F.array(overall))).drop(*[f"_{k}" for k in STRICT])


def audit(df: DataFrame, text_col: str = "text", cfg: ParseConfig = ParseConfig()) -> DataFrame:
    """Text to structure, arithmetic report and semantic checks."""
    return semantic(arithmetic(structure(df, text_col, cfg), cfg), cfg)
