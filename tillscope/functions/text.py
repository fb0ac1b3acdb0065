"""Column functions over receipt text: cleaning, lines, keywords, dates, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that tag a line, by tag, in tag order.
KEYWORDS = {
    "TOTAL": ["GRAND TOTAL", "TOTAL DUE", "AMOUNT DUE", "AMOUNT PAYABLE", "TOTAL", "NETT", "NET", "BALANCE DUE", "TO PAY"],
    "SUBTOTAL": ["SUBTOTAL", "SUB TOTAL", "SUB-TOTAL"],
    "TAX": ["TAX", "GST", "VAT", "SST", "IVA", "IGV", "TAX AMOUNT"],
    "DISCOUNT": ["DISCOUNT", "DISC", "LESS", "PROMO", "COUPON"],
    "ROUNDING": ["ROUNDING", "ROUND OFF", "ROUNDED", "RND"],
    "SERVICE": ["SERVICE", "SVC", "SERVICE CHARGE", "SERVICECHARGE"],
    "PAID": ["PAID", "PAYMENT", "CASH", "TENDERED", "RECEIVED", "CARD", "VISA", "MASTERCARD", "DEBIT", "CREDIT"],
    "CHANGE": ["CHANGE", "BALANCE", "RETURN", "REFUND", "CASHBACK"],
}
#: Lines that name no company.
COMPANY_STOPWORDS = ["RECEIPT", "TAX INVOICE", "INVOICE", "CUSTOMER COPY", "MERCHANT COPY", "THANK YOU", "WELCOME", "TEL", "PHONE", "FAX", "EMAIL", "WWW", "HTTP"]
#: The shapes of dates.
DATES = [
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b",
    r"\b\d{2,4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b",
    r"(?i:\b\d{1,2}\s*(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC)[A-Z]*\s*\d{2,4}\b)",
]
ANY_DATE = "|".join(f"(?:{d})" for d in DATES)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def clean_text(s: Column) -> Column:
    """Control characters to spaces, runs of blanks to one, no-break spaces to blanks, trimmed; in this order."""
    s = F.regexp_replace(s, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", " ")
    return strip(F.translate(F.regexp_replace(s, r"[ \t]{2,}", " "), "\u00a0", " "))


def lines(cleaned: Column) -> Column:
    """The non-empty lines, trimmed."""
    return F.filter(F.transform(F.split(cleaned, r"\R"), strip), lambda x: F.length(x) > 0)


def norm(line: Column) -> Column:
    return F.regexp_replace(F.upper(strip(line)), r"(?U)\s+", " ")


def contains_any(s: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in phrases])


def keywords(normed: Column) -> Column:
    """The tags of a line, in tag order; by substring, so CABINET is tagged TOTAL."""
    tags = F.array(*[F.when(contains_any(normed, phrases), F.lit(tag)) for tag, phrases in KEYWORDS.items()])
    return F.filter(tags, lambda t: t.isNotNull())


def has_date(line: Column) -> Column:
    return line.rlike(ANY_DATE)


def date_candidates(ls: Column, n: int = 8) -> Column:
    return F.transform(F.slice(F.filter(ls, has_date), 1, n), lambda x: F.left(x, F.lit(80)))


def dedupe(xs: Column, n: int) -> Column:
    """First occurrences, at most n."""
    return F.slice(F.array_distinct(xs), 1, n)


def quality_score(cleaned: Column, ls: Column) -> Column:
    useful = F.length(F.regexp_replace(cleaned, r"[^\p{L}\p{N}.,:\-/$%()]", ""))
    base = F.least(useful / F.greatest(F.length(cleaned), F.lit(1)) * 1.4, F.lit(1.0))
    hits = F.regexp_count(cleaned, F.lit(r"[.,]\d{2}\b"))
    bonus = (
        F.when(has_date(cleaned), 0.06).otherwise(0.0)
        + F.when(hits >= 3, 0.08).when(hits >= 1, 0.04).otherwise(0.0)
        + F.when(F.size(ls) >= 10, 0.06).when(F.size(ls) >= 5, 0.03).otherwise(0.0)
    )
    return F.least(base + bonus, F.lit(1.0))


def truncate(s: Column, n: int) -> Column:
    s = strip(s)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))).otherwise(s)


def money_text(d: Column) -> Column:
    """Two decimals, rounded half up, as text."""
    return F.round(d, 2).cast("decimal(18,2)").cast("string")


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), ext), F.lit("image/jpeg"))


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_of(path), F.lit(";base64,"), F.base64(content))


def finite(x: Column) -> Column:
    """Null for what JSON cannot hold."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
