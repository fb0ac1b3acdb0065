"""Normalising dates and times printed in mixed formats, precisions and time zones.

Raw strings are first reduced to a dictionary of distinct (raw, zone, date order); only its entries are parsed, all
in SQL expressions, and the result is joined back to the rows. Given a ``path`` the dictionary is kept there and only
entries that it lacks are parsed and added, so a daily run pays for new strings only.

The kept dictionary is a folder for each version of the parser, and in it a folder for each batch of new entries. A batch
counts only once its write is complete, so a run that fails leaves nothing that is read; two runs that add the same
entries at once add equal rows, of which one is read.

Reading of an entry:

* Dates are numeric with one of ``- / .`` throughout, compact (``YYYYMMDD``), or have an English, Spanish, Malay, German
  or French month name. Two-digit years are 20yy. Years from 2443 to 2642 are Buddhist and fall by 543. A four-digit
  year stands where it stands; other numbers are read in the site's order, or in another order if only that one gives a
  valid date (day first before month first).
* Times are ``H:MM[:SS[.f]]``, ``HhMM`` or ``HH.MM``, with or without AM/PM in any spelling, before or after the date,
  or ``HHMM[SS]`` right behind a compact date.
* An entry that is nothing but 10 or 13 digits from 1 on is a moment in seconds or milliseconds since 1970.
* An offset (``Z``, ``+0800``, ``UTC+5:30``), ``UTC``/``GMT`` or a known abbreviation holds; else the site's zone; else
  UTC. A local time that occurs twice is the earlier one; one that was skipped takes the offset before the change.
* Decimal digits of all scripts count as digits. Letter case and accents never matter.

Null entries, entries without a valid date and rows with a null or empty array give no row. Repeated entries each give
a row. Extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.session import cut, staged

#: Minutes east of UTC of the zone abbreviations that are understood.
ZONE_MINUTES = {
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "PST": -480, "PDT": -420, "COT": -300, "PET": -300,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "IST": 330, "NPT": 345,
    "ICT": 420, "WIB": 420, "MYT": 480, "SGT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
}
#: Part of the kept dictionary's path; to be raised with every change of what ``parse`` returns.
VERSION = 2
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
#: Months of other languages that do not begin like the English ones, without accents.
OTHER_MONTHS = {
    "ENERO": 1, "ENE": 1, "FEVRIER": 2, "FEV": 2, "MAC": 3, "ABRIL": 4, "ABR": 4, "AVRIL": 4, "AVR": 4, "MAI": 5, "MEI": 5, "JUIN": 6, "JUILLET": 7, "JUIL": 7,
    "AGOSTO": 8, "AGO": 8, "OGOS": 8, "AOUT": 8, "SETIEMBRE": 9, "SET": 9, "OKTOBER": 10, "OKT": 10, "DICIEMBRE": 12, "DIC": 12, "DISEMBER": 12, "DIS": 12, "DEZEMBER": 12, "DEZ": 12,
}

_MONTH = rf"((?:{'|'.join(OTHER_MONTHS)})(?![A-Z])|{'|'.join(MONTHS)})[A-Z]*\.?"
_YEAR_FIRST = r"(?<![0-9])([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?![0-9])"
_YEAR_LAST = r"(?<![0-9]|[0-9][.:])([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})(?![0-9:])"
_DAY_NAME = rf"(?<![0-9]|[0-9][.:])([0-9]{{1,2}})\.?[ -]*(?:DE )?{_MONTH}(?: DEL?(?= ))?[ ,-]*([0-9]{{4}}|[0-9]{{2}})(?![0-9:])"
_NAME_DAY = rf"(?<![A-Z]){_MONTH} *([0-9]{{1,2}}),? *([0-9]{{4}})(?![0-9:])"
_COMPACT = r"(?<![0-9])((?:19|20)[0-9]{2})(0[1-9]|1[0-2])([0-3][0-9])(?:[T ]?([0-2][0-9])([0-5][0-9])([0-5][0-9])?(?:[.,][0-9]+)?)?(?![0-9:])(.*)$"
_EPOCH = r"^\s*(1[0-9]{9})([0-9]{3})?\s*$"
_ANY_DATE = "|".join(f"(?:{p})" for p in (
    _YEAR_FIRST.replace(r"\2", r"[-/.]"), _YEAR_LAST.replace(r"\2", r"[-/.]"), _DAY_NAME, _NAME_DAY))
_TIME = r"(?<![0-9]|[0-9][.:])([0-9]{1,2})([:H.])([0-9]{2})(?:[:.]([0-9]{2})(?:[.,][0-9]+)?)?(?![0-9]) *(?:([AP])\.? ?M\b\.?)?(.*)$"
_OFFSET = r"^ *\(?(?:UTC|GMT)? *([+-])([0-9]{1,2}):?([0-9]{2})?(?![0-9])"


# Every decimal digit that is not ASCII, and full-width punctuation, with what they stand for.
_DIGITS = {chr(i): str(unicodedata.decimal(chr(i))) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"} | dict(zip("：／．－", ":/.-", strict=True))
_WIDE, _ASCII = "".join(_DIGITS), "".join(_DIGITS.values())
_ACCENTS = ("ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOUUUUNC")


def _x(s: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def _int(s: Column) -> Column:
    return s.try_cast("int")


def _valid(y: Column, m: Column, d: Column) -> Column:
    """The date y-m-d, null if there is none such."""
    year = F.when(F.length(y) == 2, 2000 + _int(y)).otherwise(_int(y))
    year = F.when(year.between(2443, 2642), year - 543).otherwise(year)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(_int(m).cast("string"), 2, "0"), F.lpad(_int(d).cast("string"), 2, "0"))
    ok = y.isNotNull() & m.isNotNull() & d.isNotNull() & (year > 0)
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def parse(entries: DataFrame) -> DataFrame:
    """(raw, zone, date_order) -> the same with utc_value, null where the entry holds no valid date."""
    keys = ["raw", "zone", "date_order"]
    s = F.col("_s")
    plain = F.upper(F.translate("raw", _WIDE, _ASCII))
    e = staged(entries.select(*keys), _s=F.when(plain.rlike("[^\\x00-\\x7f]"), F.translate(F.regexp_replace(plain, r"\p{M}", ""), *_ACCENTS)).otherwise(plain))
    e = staged(
        e,
        **{f"f{g}": _x(s, _YEAR_FIRST, g) for g in (1, 3, 4)},
        **{f"l{g}": _x(s, _YEAR_LAST, g) for g in (1, 3, 4)},
        **{f"d{g}": _x(s, _DAY_NAME, g) for g in (1, 2, 3)},
        **{f"n{g}": _x(s, _NAME_DAY, g) for g in (1, 2, 3)},
        **{f"c{g}": _x(s, _COMPACT, g) for g in (1, 2, 3, 4, 5, 6, 7)},
        _epoch=_x(s, _EPOCH, 1).cast("long"),
        _rest=F.regexp_replace(s, _ANY_DATE, "|"),
    )
    names = F.create_map(*[F.lit(v) for m, i in (dict(zip(MONTHS, range(1, 13), strict=True)) | OTHER_MONTHS).items() for v in (m, str(i))])
    ymd = F.when(F.length("l4") == 2, _valid(F.col("l1"), F.col("l3"), F.col("l4")))
    e = staged(
        e,
        _f=F.coalesce(_valid(F.col("f1"), F.col("f3"), F.col("f4")), _valid(F.col("f1"), F.col("f4"), F.col("f3"))),
        _w=F.coalesce(_valid(F.col("d3"), F.element_at(names, F.col("d2")), F.col("d1")), _valid(F.col("n3"), F.element_at(names, F.col("n1")), F.col("n2"))),
        dmy=_valid(F.col("l4"), F.col("l3"), F.col("l1")),
        mdy=_valid(F.col("l4"), F.col("l1"), F.col("l3")),
        ymd=ymd,
        compact=_valid(F.col("c1"), F.col("c2"), F.col("c3")),
        **{f"t{g}": _x(F.col("_rest"), _TIME, g) for g in (1, 3, 4, 5, 6)},
    )
    order = F.coalesce("date_order", F.lit("DMY"))
    last = F.when(order == "MDY", F.coalesce("mdy", "dmy", "ymd")).when(order == "YMD", F.coalesce("ymd", "dmy", "mdy")).otherwise(F.coalesce("dmy", "mdy", "ymd"))
    hour, half = _int(F.col("t1")), F.col("t5")
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    e = staged(e, _known=F.coalesce("_f", "_w", last))
    # The time stands behind a compact date, or anywhere outside the date.
    tight = F.col("_known").isNull() & F.col("compact").isNotNull() & F.col("c4").isNotNull()
    pick = lambda a, b: F.when(tight, a).otherwise(b)
    e = staged(
        e, _day=F.coalesce("_known", "compact"), _h=pick(_int(F.col("c4")), hour), _m=pick(_int(F.col("c5")), _int(F.col("t3"))),
        _sec=F.coalesce(pick(_int(F.col("c6")), _int(F.col("t4"))), F.lit(0)), _tail=pick(F.col("c7"), F.col("t6")),
    )
    timed = (F.col("_h") < 24) & (F.col("_m") < 60) & (F.col("_sec") < 60)
    t = F.col("_tail")
    sign = F.when(_x(t, _OFFSET, 1) == "-", -1).otherwise(1)
    offset = sign * (_int(_x(t, _OFFSET, 2)) * 60 + F.coalesce(_int(_x(t, _OFFSET, 3)), F.lit(0)))
    known = F.create_map(*[F.lit(v) for k, m in ZONE_MINUTES.items() for v in (k, m)])
    abbreviation = _x(t, r"(?<![A-Z])(" + "|".join(sorted(ZONE_MINUTES, key=len, reverse=True)) + r")(?![A-Z])", 1)
    utc = F.when(_x(t, r"^ *\(?(Z|UTC|GMT)(?![A-Z])", 1).isNotNull(), 0)
    e = staged(
        e,
        _local=F.when(timed, F.timestamp_seconds(F.unix_date("_day").cast("long") * 86400 + F.col("_h") * 3600 + F.col("_m") * 60 + F.col("_sec"))),
        _minutes=F.coalesce(offset, utc, F.element_at(known, abbreviation)),
    )
    zoned = F.to_utc_timestamp("_local", F.coalesce("zone", F.lit("UTC")))
    moment = F.when(F.col("_minutes").isNotNull(), F.timestamp_seconds(F.unix_seconds("_local") - F.col("_minutes") * 60)).otherwise(zoned)
    text = F.when(F.col("_local").isNotNull(), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("_day", "yyyy-MM-dd"))
    since = F.date_format(F.timestamp_seconds("_epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(*keys, F.when(F.col("_day").isNotNull(), text).otherwise(since).alias("utc_value"))


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """The complete batches in a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = (p.getPath() for p in fs.listStatus(path) if p.isDirectory())
    return sorted(p.toString() for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def dictionary(entries: DataFrame, path: str | None = None) -> DataFrame:
    """The parsed dictionary of distinct (raw, zone, date_order).

    With ``path`` it is kept in that folder, to which the entries it lacks are added first.
    """
    spark = entries.sparkSession
    keys = ["raw", "zone", "date_order"]
    distinct = entries.select(*keys).distinct()
    if path is None:
        return cut(parse(distinct))
    folder = f"{path}/parser={VERSION}"
    read = lambda batches: spark.read.parquet(*batches) if len(batches) == 1 else spark.read.parquet(*batches).dropDuplicates(keys)
    known = _batches(spark, folder)
    if known:
        old = spark.read.parquet(*known).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        distinct = distinct.join(old, same, "left_anti")
    batch = f"{folder}/batch-{uuid.uuid4().hex}"
    parse(distinct).write.parquet(batch)
    return read([*known, batch])


def normalise(rows: DataFrame, sites: DataFrame, id_col: str = "ocr_id", entries: str = "date_candidates", site: str = "site_code", path: str | None = None, max_broadcast_sites: int = 100_000) -> DataFrame:
    """(id_col, pos, utc_value): one row per array entry that holds a valid date; pos counts from 0, null entries included."""
    site_rows = sites.select(F.col("site_code").alias("_site"), F.col("time_zone").alias("zone"), "date_order").dropDuplicates(["_site"])
    if site_rows.limit(max_broadcast_sites + 1).count() <= max_broadcast_sites:
        site_rows = F.broadcast(site_rows)
    each = rows.select(F.col(id_col), F.col(site).alias("_site"), F.posexplode(entries).alias("pos", "raw")).where(F.col("raw").rlike(r"\p{Nd}"))
    each = each.join(site_rows, "_site", "left").select(id_col, "pos", "raw", "zone", "date_order")
    keys = ["raw", "zone", "date_order"]
    found = dictionary(each, path).where("utc_value is not null").select(*[F.col(k).alias(f"_{k}") for k in keys], "utc_value")
    on = (F.col("raw") == F.col("_raw")) & F.col("zone").eqNullSafe(F.col("_zone")) & F.col("date_order").eqNullSafe(F.col("_date_order"))
    return each.join(found, on).select(id_col, "pos", "utc_value")
