"""Money tokens in a line, in SQL expressions.

One pattern finds dates and amounts alike, so that what belongs to a date is never an amount; a date also swallows the
digits that the amount pattern would have joined to it. An amount needs decimals or a currency, or to be at least 10.

The default reading keeps known quirks: groups of at most three digits come first, so 1234.56 is 123 and 4.56; blanks
separate thousands, so QTY 5 100.00 is 5100.00; 1,234 has three decimals; currencies match inside words.
``compat=False`` reads ungrouped amounts whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.functions.text import ANY_DATE
from tillscope.session import let

#: Currency marks.
_CUR = r"(?i:RM|MYR|USD|SGD|EUR|GBP|COP|MXN|BRL|PEN|\$|€|£)"
_TAIL = rf"(?:[.,\s](?!{ANY_DATE})\d{{3}})*(?:[.,]\d{{2,3}})?[)\-]?"
#: The shapes of grouped and of plain amounts.
_GROUPED = r"[(\-]?\d{1,3}(?:[.,\s]\d{3})*(?:[.,]\d{2,3})?[)\-]?"
_PLAIN = r"[(\-]?\d+(?:[.,]\d{2,3})?[)\-]?"


def pattern(compat: bool = True) -> str:
    """Group 1 is the currency, group 2 the number; both empty for a date."""
    number = f"{_GROUPED}|{_PLAIN}" if compat else rf"[(\-]?\d{{1,3}}(?:[.,]\d{{3}})+(?:[.,]\d{{2,3}})?(?!\d)[)\-]?|{_PLAIN}"
    date = f"(?:{ANY_DATE})"
    # An amount whose groups would run into a date belongs to the date, too.
    joined = rf"{_CUR}?\s*[(\-]?\d{{1,3}}(?:[.,\s]\d{{3}})*[.,\s](?=\d{{3}}){date}"
    return rf"{date}{_TAIL}|(?!{_CUR}?\s*[(\-]?{date})(?!{joined})({_CUR})?\s*({number})(?!\s*%)"


def _plain_number(digits: Column) -> Column:
    """The separators of a number decided: both kinds, the last is decimal; one kind, decimal before 2 or 3 digits."""
    back = F.reverse(digits)
    after_dot, after_com = F.instr(back, ".") - 1, F.instr(back, ",") - 1  # -1: there is none
    return (
        F.when((after_dot >= 0) & (after_com >= 0) & (after_dot < after_com), F.translate(digits, ",", ""))
        .when((after_dot >= 0) & (after_com >= 0), F.translate(F.translate(digits, ".", ""), ",", "."))
        .when(after_dot.isin(2, 3), digits)
        .when(after_dot >= 0, F.translate(digits, ".", ""))
        .when(after_com.isin(2, 3), F.translate(digits, ",", "."))
        .otherwise(F.translate(digits, ",", ""))
    )


def parse_decimal(num: Column) -> Column:
    """decimal(18,3) of an amount's text, null if it is none."""

    def read(s: Column) -> Column:
        negative = s.rlike(r"^\(.*\)$|^[\s\d.,]*\d[\s.,]*-$|^-")
        bare = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "$1"), r"^-|(?<=[\d.,\s])-$|\s+", "")
        value = let(let(bare, _plain_number), lambda p: F.when(p.rlike(r"^(\d+\.?\d*|\.\d+)$"), p.try_cast("decimal(18,3)")))
        return F.when(negative, -value).otherwise(value).cast("decimal(18,3)")

    return let(F.trim(num), read)


def money_tokens(line: Column, limit: int = 6, compat: bool = True) -> Column:
    """array<struct<raw,value,currency>> of a line."""
    p = F.lit(pattern(compat))
    found = F.arrays_zip(F.regexp_extract_all(line, p, 1).alias("cur"), F.regexp_extract_all(line, p, 2).alias("num"))

    def worth(t: Column) -> Column:
        decimals = t["num"].rlike(r"[.,]\d{2,3}\b")
        number = F.coalesce(F.regexp_replace(t["num"], r"\D", "").try_cast("decimal(38,0)"), F.lit(0))
        return (t["num"] != "") & (decimals | (t["cur"] != "") | (number >= 10))

    tokens = F.transform(F.filter(found, worth), lambda t: F.struct(F.trim(F.concat(t["cur"], t["num"])).alias("raw"), parse_decimal(t["num"]).alias("value"), F.nullif(F.upper(t["cur"]), F.lit("")).alias("currency")))
    return F.slice(F.filter(tokens, lambda t: t["value"].isNotNull()), 1, limit)


def line_amount(money: Column, policy: str = "rightmost") -> Column:
    if policy == "largest":
        top = F.array_max(F.transform(money, lambda t, i: F.struct(F.abs(t["value"]).alias("a"), (-i).alias("i"), t["value"].alias("v"))))
        return top["v"]
    return F.when(F.size(money) > 0, F.element_at(money, -1)["value"])


def sorted_amounts(money_by_line: Column, limit: int = 40) -> Column:
    """Distinct amounts to two decimals, ascending, as text."""
    two = F.transform(F.flatten(money_by_line), lambda t: F.round(t["value"], 2).cast("decimal(18,2)"))
    return F.transform(F.slice(F.array_sort(F.array_distinct(two)), 1, limit), lambda d: d.cast("string"))
