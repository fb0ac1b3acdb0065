"""Sentence units of documents in many languages, scripts and layouts, in SQL expressions only.

Every mark that could end a sentence but does not is first masked by a private-use character, one for one, so that
offsets stay true: points in decimals, URLs, file names, initials, abbreviations, list numbers and German ordinals, and
all marks inside quotations. Then a separator goes in behind each remaining end:

* a mark (``. ! ? …`` and those of Arabic, Devanagari and Greek) with its closing marks, before white space and
  something other than a lower-case letter; also where the space was forgotten between a word and a capital;
* ``。！？`` with their closing marks, anywhere; ``……`` between Han characters;
* a mark at the end of a quotation ends the sentence only if what follows could begin one; without spaces between
  sentences, only if a colon led to the quotation;
* in Thai a space, unless a digit stands beside it or a point before it; a single line end never by itself;
* a blank line always. In layout ``lines`` every line end, and nothing else.

Layout null or unknown counts as ``flow``. Null, empty and blank texts give no row. Units carry no surrounding white
space (Unicode's). Repeated rows each give their units. Private-use characters of the text itself count as letters.
A straight quote without a partner in its paragraph opens nothing.

Scale: a narrow map without a shuffle; all patterns run inside the JVM, with look-behind only from a candidate mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.session import let, staged

W = r"\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE = r"(?:\r\n|[\n\r\u2028\u2029\u0085\u000B\u000C])"
# One character that ends a line: a class is looked up faster than the alternatives of _LINE, at every character of a text.
_ANY_END = r"[\n-\r\u0085\u2028-\u2029]"
#: Placeholders: a masked mark, the last mark of a quotation, a mark that ends in any script, paragraph and unit separators.
MASK, LAST, END, PARA, UNIT = "\ue000", "\ue001", "\ue002", "\ue0fe", "\ue0ff"
TERMS = ".!?…;؟।॥。！？｡"
_CLOSE = r"\"'”’»\)\]）」』】》〉›“"
_OPEN = r"\"'“„«‘\(\[（「『¿¡‹—–-"
#: What may begin a sentence: anything but a lower-case letter or a mark that goes on; stray symbols before it are skipped.
_NEXT = rf"(?=[{W}][{W}\p{{So}}\p{{Sk}}\p{{Cf}}\p{{Cc}}≈√]*+[{_OPEN}]*[{W}]?[{_OPEN}]*[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}\p{{Sc}}#*])"
#: Abbreviations that do not end a sentence.
NEVER = (
    "Mr|Mrs|Ms|Dr|Prof|St|Messrs|Hon|Gen|Col|Capt|Lt|Sgt|Sdn|Pte|Ref|Inv|Fig|fig|Figs|figs|approx|Approx|rev|Rev|ed|vol|Vol|"
    "pp|vs|viz|cf|Cf|al|ca|Ca|Nr|Hr|Fr|Hrn|Bd|Abb|Tab|bzw|Bzw|vgl|Vgl|inkl|zzgl|evtl|ggf|sog|Str|"
    r"Sr|Sra|Srta|Sres|Dra|Ud|Uds|aprox|Aprox|ej|[nN](?:ú|u\u0301)m|[pP](?:á|a\u0301)gs?|tel|Tel|Av|Avda|"
    "Mme|Mlle|MM|env|Env|chap|éd|hlm|Hlm|En|Pn|Tn|Cik|Hj|Ir|bil|Bil|spt|"
    "κ|κα|κκ|αρ|Αρ|σελ|Σελ|βλ|Βλ|δηλ|τηλ|د|ص|أ|ت|م|डॉ|क्र|पृ|पं|रु|सं"
)
#: Abbreviations of "number" that do not end a sentence before a number or code.
NUMBER = "no|No|nos|Nos|NO|nr|art|Art|item|sec|Sec|ch|Ch"
#: Units of a block in the first step of their offsets.
BLOCK = 128
MONTHS_DE = "Januar|Jänner|Februar|März|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def _sub(s: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(s, pattern, by)


def _mask_quotes(p: Column) -> Column:
    """Mask the marks inside quotations of a paragraph; the last mark of each becomes LAST."""
    inner = "".join(TERMS)

    def straight(x: Column) -> Column:
        def inside(n: Column):
            def one(y: Column, i: Column) -> Column:
                quoted = (i % 2 == 1) & (i < n - 1)
                return F.when(quoted, F.translate(_sub(y, rf"[{inner}]$", LAST), inner, MASK * len(inner))).otherwise(y)

            return one

        # Bound once: else the text would be split again for every part.
        whole = lambda parts: let(F.size(parts), lambda n: F.array_join(F.transform(parts, inside(n)), '"'))
        return F.when(F.instr(x, '"') > 0, let(F.split(x, '"'), whole)).otherwise(x)

    def paired(opening: str, closing: str):
        """Of each stretch up to a closing mark, what stands behind its last opening mark is inside. Every stretch is read once."""

        def masked(y: Column) -> Column:
            tail = F.element_at(F.split(y, f"[{opening}]"), -1)
            return F.concat(F.left(y, F.length(y) - F.length(tail)), F.translate(tail, inner, MASK * len(inner)))

        def ended(x: Column) -> Column:
            parts = F.split(_sub(x, rf"[{inner}](?=[{W}]?[{closing}])", LAST), f"(?<=[{closing}])")
            each = lambda n: lambda y, i: F.when(i < n - 1, let(y, masked)).otherwise(y)
            return let(parts, lambda ps: let(F.size(ps), lambda n: F.array_join(F.transform(ps, each(n)), "")))

        return lambda x: F.when(x.rlike(f"[{closing}]"), let(x, ended)).otherwise(x)

    def curly(x: Column) -> Column:
        out = x
        for f in (paired("“", "”"), paired("«", "»"), paired("「", "」"), paired("『", "』")):
            out = let(out, f)
        return let(out, lambda y: F.when(F.instr(y, "„") > 0, paired("„", "“”")(y)).otherwise(y))

    # Most paragraphs have no quotation at all.
    p = let(p, straight)
    return let(p, lambda x: F.when(x.rlike("[”»」』“]"), curly(x)).otherwise(x))


def _mask_points(p: Column) -> Column:
    """Mask the points that end no sentence."""
    p = _sub(p, r"\.(?=[\p{Ll}\p{N}_/])(?<=[^\s]\.)", MASK)
    p = _sub(p, rf"\.(?<=(?<![\p{{L}}\p{{N}}\p{{M}}.{MASK}])(?:\p{{L}}|{NEVER})\.)", MASK)
    p = _sub(p, rf"\.(?<=(?<![\p{{L}}\p{{N}}])(?:{NUMBER})\.)(?=[{W}]*(?:[\p{{N}}*#]|\p{{Lu}}-?\p{{N}}))", MASK)
    p = _sub(p, rf"\.(?<=(?<![\p{{N}}.,])\p{{N}}{{1,2}}\.)(?=[{W}]+(?:{MONTHS_DE})(?![\p{{L}}]))", MASK)
    p = _sub(p, r"\.(?<=\p{IsThai}\.)", MASK)
    return _sub(p, rf"^([{W}]*\p{{N}}{{1,3}})\.(?=[{W}])|((?:^|[.!?:…])[{W}]{{0,4}}\n[{W}]{{0,4}}\p{{N}}{{1,3}})\.(?=[{W}])", f"$1$2{MASK}")


def _separate(p: Column) -> Column:
    """Put UNIT behind every sentence end of a masked paragraph. Rules of a script run only where it occurs."""

    def where(x: Column, there: Column, pattern: str, by: str) -> Column:
        return F.when(there, _sub(x, pattern, by)).otherwise(x)

    rules = [
        lambda x: where(x, F.instr(x, ";") > 0, rf";(?<=\p{{IsGreek}}[\u0300-\u036f]?;)(?=[{W}]|$)", END),
        lambda x: where(x, F.instr(x, LAST) > 0, rf"([：:][{W}]?[“「『\"][^“”「」『』\"]*){LAST}(?=[”」』\"](?:[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}（]|$))", f"$1{END}"),
        lambda x: where(x, F.instr(x, "……") > 0, r"(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])……(?=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{N}“「（])", f"…{END}"),
        lambda x: _sub(x, rf"([.!?…؟।॥{LAST}{END}][.!?…؟।॥]*+[{_CLOSE}]*+){_NEXT}", f"$1{UNIT}"),
        lambda x: where(x, x.rlike(f"[。！？｡{END}]"), rf"([。！？｡{END}][。！？｡!?…]*+[{_CLOSE.replace('“', '')}]*+)(?=[^{W}{UNIT}，、；：,;:])", f"$1{UNIT}"),
        lambda x: where(x, x.rlike(r"[.!?][\"”»\)]?[¿¡«“\(]?\p{Lu}"), rf"((?:[\p{{Ll}}\p{{M}}]{{2}}|\p{{N}}{{2}})[.!?][\"”»\)]?+)(?=[¿¡«“\(]?\p{{Lu}}\p{{M}}?\p{{Ll}})", f"$1{UNIT}"),
        lambda x: where(x, x.rlike("[\u0e00-\u0e7f]"), r"(?<=[\p{IsThai}&&[^๐-๙]])[ \t\u00A0\u2009\u3000]+(?=[^\p{N}\s])(?![\n\r])", f"{UNIT}$0"),
    ]
    for rule in rules:
        p = let(p, rule)
    return p


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout_col: str = "layout") -> DataFrame:
    """(id_col, start_char, end_char) of every unit."""
    used = MASK + LAST + END + PARA + UNIT
    d = documents.select(F.col(id_col), F.when(F.col(text_col).rlike(f"[{MASK}-{UNIT}]"), F.translate(F.col(text_col), used, "\ufffd" * len(used))).otherwise(F.col(text_col)).alias("_t"), (F.coalesce(F.col(layout_col), F.lit("flow")) == "lines").alias("_lines"))
    d = d.where(F.col("_t").rlike(rf"[^{W}]"))
    paragraphs = F.split(_sub(F.col("_t"), rf"({_ANY_END}(?:(?<=\r)\n)?+[{W}&&[^\n\r]]*{_ANY_END}[{W}]*)", f"$1{PARA}"), PARA)
    d = staged(d, _p=F.when(F.col("_lines"), F.array(_sub(F.col("_t"), f"({_LINE})", f"$1{UNIT}"))).otherwise(paragraphs))
    d = staged(d, _q=F.when(F.col("_lines"), F.col("_p")).otherwise(F.transform("_p", _mask_quotes)))
    d = staged(d, _m=F.when(F.col("_lines"), F.col("_q")).otherwise(F.transform("_q", _mask_points)))
    marked = F.array_join(F.when(F.col("_lines"), F.col("_m")).otherwise(F.transform("_m", _separate)), UNIT)
    d = staged(d, _u=F.split(marked, UNIT))
    # Offsets go from block to block and from unit to unit within a block, so no list of many units is copied for each of them.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_u") - 1) / BLOCK).cast("int")), lambda i: F.slice("_u", i * BLOCK + 1, BLOCK))
    sizes = F.transform("_b", lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, u: acc + F.length(u)))
    longs = F.array().cast("array<bigint>")
    starts = F.aggregate("_n", F.struct(F.lit(0).cast("bigint").alias("at"), longs.alias("all")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
    d = staged(staged(d, _b=blocks).drop("_u"), _n=sizes)
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def step(acc: Column, u: Column) -> Column:
        n = F.length(u).cast("bigint")
        lead = n - F.length(F.ltrim(u, F.lit(SPACES)))
        # Few units end with white space, and only those are trimmed there.
        tail = F.when(F.substring(u, -1, 1).isin(*SPACES), n - F.length(F.rtrim(u, F.lit(SPACES)))).otherwise(F.lit(0).cast("bigint"))
        one = F.array(F.struct((acc["at"] + lead).alias("s"), (acc["at"] + n - tail).alias("e")))
        return F.struct((acc["at"] + n).alias("at"), F.when(lead < n, F.concat(acc["units"], one)).otherwise(acc["units"]).alias("units"))

    units = lambda x: F.aggregate(x["_b"], F.struct(x["_o"].alias("at"), none.alias("units")), step)["units"]
    spans = F.flatten(F.transform(F.arrays_zip("_b", starts.alias("_o")), units))
    return d.select(id_col, F.explode(spans).alias("_s")).select(id_col, F.col("_s.s").alias("start_char"), F.col("_s.e").alias("end_char"))
