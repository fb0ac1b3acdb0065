"""Mapping freely typed values to the entries of a canonical catalogue.

Distinct values form a dictionary; only it is worked on. A value loses decorations (brackets, labels, quotes) and
falls into words, folded so that accents, case and letters that scanners or typists swap for digits are equal.

Repair: each distinct word is joined to the vocabulary of the catalogue (codes, titles, descriptions, titles in other
languages, codes typed as one word) by edit distance, over shared deletion variants, so no word meets all others. The
nearest vocabulary word within the tolerance stands for it: one edit up to five letters, two up to eight, three beyond,
a swap of neighbours being one. Words cut short or with letters left out are repaired as abbreviations.

Ranking: soft TF-IDF. A value's score for an entry is the sum of similarity x inverse entry frequency x field weight of
its words, over the sum that it would have if every word were the entry's. Words that the catalogue lacks count with
four fifths of the highest inverse frequency, function words and mere judgements ("wrong") with none. The best entry
stands if its score is at least ``score``, or ``judged`` where the value says that something is wrong; words that affirm ("confirmed", "plausible") and a leading negation of a whole code make the value
unmatched. Ties go to the entry of which more of the code is matched, then to the code in alphabetical order.

Null, blank and exactly matching values are no rows. Repeated values and rows are each reported. An empty catalogue
leaves everything unmatched.

Scale: the dictionary is joined back by the value; equal values in a third of all rows meet one dictionary row, and
adaptive execution splits that key. The vocabulary is broadcast only if it has at most ``max_broadcast_words`` words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import cut, staged

UNMATCHED = "UNMATCHED"
#: Words without weight: function words, hedges and mere judgements.
WEIGHTLESS = (
    "a an the of is are was were be in on at to and or for with from by as it its this that one some has have had do does did not no don doesn isn t s "
    "too so up add adds than there here what which possible possibly probable probably maybe detected found seen visible present flag flagged issue around "
    "wrong bad incorrect incorrectly weird odd strange faulty el la los las lo de del en y o un una por con es son se al que mal erroneo erronea "
    "demasiado muy yang di pada ini itu dan ke dengan salah"
).split()
#: Words of the domain at large, which point to no entry.
DOMAIN = "scan scans image receipt receipts paper photo document trace traces next resit recibo".split()
#: Weightless words that say that something is wrong.
JUDGING = "wrong bad incorrect incorrectly weird odd strange faulty mal erroneo erronea salah not don doesn isn".split()
#: Words that affirm that nothing is wrong.
AFFIRMING = "ok okay fine good confirmed verified plausible consistent normal valid correct novedad genuine authentic exempt".split()
#: Negations that may lead a code.
NEGATIONS = "no not non without sin tiada tanpa".split()
#: Phrases and words and what they are read as.
READ_AS = {r"!=|<>|≠": " differs ", r"\b(?:do|does|did)(?:es)?(?: not|n.?t) match\b": " mismatch ", r"\bno cuadran?\b": " wrong ", r"\bon top\b": " over ", r"\bmis(?=calcul|print|stat)": " wrong ", r"\barticulos?\b": " item "}
_ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
_FOLD = ("01583f", "oisbee")


def _plain(s: Column) -> Column:
    s = F.translate(F.regexp_replace(F.lower(s), r"\p{M}", ""), *_ACCENTS)
    s = F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]|_", " ")
    for pattern, by in READ_AS.items():
        s = F.regexp_replace(s, pattern, by)
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def _words(plain: Column) -> Column:
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _fold(w: Column) -> Column:
    """Confusable characters made equal, and plural and comparative endings off."""
    stem = F.when(F.length(w) >= 7, F.regexp_replace(w, "(?:ier|er|y)$", "")).otherwise(w)
    stem = F.when((F.length(stem) >= 6), F.regexp_replace(stem, "y$", "")).otherwise(stem)
    return F.translate(F.when((F.length(stem) >= 4) & ~F.endswith(stem, F.lit("ss")), F.regexp_replace(stem, "s$", "")).otherwise(stem), *_FOLD)


def _deletions(w: Column) -> Column:
    """The word and its variants with one or two letters left out."""

    def less(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, F.length(x))))

    one = F.when(F.length(w) >= 4, less(w)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(w) >= 6, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(w), one, two))


def _quarters(w: Column, shifts: bool) -> Column:
    """Keys of words of nine letters and more: their four quarters, one of which three edits leave whole.

    Of the other word (``shifts``) every piece of a length that a quarter of the first can have, within three places.
    """
    n = F.length(w)

    def cut(m: Column) -> Column:
        """The quarters of a word of length m, as the places and pieces that they have in w."""
        at = lambda i: F.floor(m * i / 4).cast("int")
        moves = F.sequence(F.lit(-3), F.lit(3)) if shifts else F.array(F.lit(0))
        # Length, number and piece of the quarter, as it would be in a word of length m.
        each = lambda i: F.transform(
            F.filter(moves, lambda k: (at(i) + k >= 0) & (at(i + 1) + k <= n)), lambda k: F.concat_ws("|", m.cast("string"), F.lit(str(i)), F.substring(w, at(i) + k + 1, at(i + 1) - at(i)))
        )
        return F.concat(*[each(i) for i in range(4)])

    lengths = F.sequence(F.greatest(n - 3, F.lit(4)), n + 3) if shifts else F.array(n)
    return F.when(n >= (6 if shifts else 4), F.array_distinct(F.flatten(F.transform(lengths, cut)))).otherwise(F.array().cast("array<string>"))


def _skeleton(c: str) -> Column:
    """The first letter and the consonants after it."""
    return F.concat(F.left(c, F.lit(1)), F.translate(F.substring(F.col(c), 2, 1_000_000), "aeiou", ""))


def _openings(c: str) -> Column:
    """How the skeleton of a word with letters left out may open: the first letter, alone or with any one consonant of the rest."""
    rest = F.translate(F.substring(F.col(c), 2, 1_000_000), "aeiou", "")
    return F.concat(F.array(F.left(c, F.lit(1))), F.transform(F.array_distinct(F.filter(F.split(rest, ""), lambda x: x != "")), lambda x: F.concat(F.left(c, F.lit(1)), x)))


def _near(a: Column, b: Column) -> Column:
    """Similarity of two folded words, null beyond the tolerance."""
    n = F.greatest(F.length(a), F.length(b))
    d = F.levenshtein(a, b)
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    swap = (F.length(a) == F.length(b)) & (d == 2) & (letters(a) == letters(b))
    d = F.when(swap, 1).otherwise(d)
    limit = F.when(n <= 3, 0).when(n <= 5, 1).when(n <= 8, 2).otherwise(3)
    return F.when(d <= limit, 1 - d / n)


def vocabulary(catalogue: DataFrame) -> DataFrame:
    """(v, entry, weight, in_code): words of each entry with the weight of their best field."""
    fields = {"flag_code": 1.0, "title": 0.97, "title_es": 1.0, "title_ms": 1.0, "description": 0.9}
    each = [catalogue.select(F.col("flag_code").alias("entry"), F.explode(_words(_plain(F.col(c)))).alias("v"), F.lit(w).alias("weight"), F.lit(c == "flag_code").alias("in_code")) for c, w in fields.items()]
    joined = catalogue.select(F.col("flag_code").alias("entry"), F.regexp_replace(_plain(F.col("flag_code")), " ", "").alias("v"), F.lit(1.0).alias("weight"), F.lit(True).alias("in_code"))
    out = joined
    for e in each:
        out = out.unionByName(e)
    out = out.where(~F.col("v").isin(WEIGHTLESS + DOMAIN) & (F.length("v") >= 2) & (F.col("v") != ""))
    # Of a noun in -ncy the adjective is known too.
    out = out.unionByName(out.where(F.endswith("v", F.lit("ncy"))).withColumn("v", F.regexp_replace("v", "cy$", "t")))
    return out.groupBy("v", "entry").agg(F.max("weight").alias("weight"), F.max("in_code").alias("in_code"))


def repair(words: DataFrame, known: DataFrame) -> DataFrame:
    """(w, v, sim): the nearest known words (v, titled) of each distinct word (w); words without any are left out.

    Only words that stand in a code or title are abbreviated.
    """
    w = cut(words.select("w", _fold(F.col("w")).alias("fw")))
    k = cut(known.select("v", "titled", _fold(F.col("v")).alias("fv")))
    # Words of up to eight letters meet by deletions, longer ones (up to three edits) by a quarter that is whole in both.
    few = lambda c: _deletions(F.when(F.length(c) <= 10, F.col(c)).otherwise(F.lit("")))
    by = w.select("w", "fw", F.explode(few("fw")).alias("x")).where("x <> ''").join(k.select("v", "fv", F.explode(few("fv")).alias("x")).where("x <> ''"), "x")
    long_ = w.select("w", "fw", F.explode(_quarters(F.col("fw"), False)).alias("x")).join(k.select("v", "fv", F.explode(_quarters(F.col("fv"), True)).alias("x")), "x")
    by = by.select("w", "v", "fw", "fv").unionByName(long_.where(F.greatest(F.length("fw"), F.length("fv")) >= 9).select("w", "v", "fw", "fv")).distinct()
    near = cut(by).select("w", "v", _near(F.col("fw"), F.col("fv")).alias("sim")).where("sim is not null")
    # Abbreviations: beginnings, and words with letters left out, which meet by first letter and next consonant.
    cutoff = w.where(F.length("fw") >= 3)
    starts = k.where((F.length("fv") > 3) & F.col("titled")).select("v", "fv", F.explode(F.transform(F.sequence(F.lit(3), F.length("fv") - 1), lambda i: F.left("fv", i))).alias("fw"))
    begun = cutoff.join(starts, "fw").select("w", "v", (0.75 + 0.2 * F.length("fw") / F.length("fv")).alias("sim"))
    vowels = F.length("fw") - F.length(F.translate("fw", "aeiou", ""))
    sparse = cutoff.where(vowels * 3 <= F.length("fw")).withColumn("i", F.left(_skeleton("fw"), F.lit(2)))
    full = k.where("titled").withColumn("i", F.explode(_openings("fv")))
    spread = F.concat(F.lit("^"), F.regexp_replace("fw", "(.)", "$1.*"))
    sparse = sparse.join(full, "i").where((F.length("fv") > F.length("fw")) & (F.length("fv") <= F.length("fw") * 3)).where(F.rlike(F.col("fv"), spread))
    sparse = sparse.select("w", "v", (0.7 + 0.2 * F.length("fw") / F.length("fv")).alias("sim"))
    every = near.unionByName(begun).unionByName(sparse).groupBy("w", "v").agg(F.max("sim").alias("sim"))
    top = every.groupBy("w").agg(F.max("sim").alias("top"))
    return every.join(top, "w").where(F.col("sim") >= F.col("top") - 1e-9).select("w", "v", "sim")


def match(values: DataFrame, catalogue: DataFrame, score: float = 0.5, judged: float = 0.42, max_broadcast_words: int = 100_000) -> DataFrame:
    """(raw, entry) of distinct non-blank values (raw); entry is UNMATCHED where none fits."""
    entries = catalogue.where("flag_code is not null").dropDuplicates(["flag_code"])
    vocab = cut(vocabulary(entries))
    n = float(max(entries.count(), 2))
    # An entry that has a word only in its description counts half. Words are one if they fold to the same.
    vocab = vocab.withColumn("f", _fold(F.col("v"))).withColumn("titled", F.col("weight") > 0.9)
    idf = vocab.groupBy("f", "entry").agg(F.max(F.when(F.col("titled"), 1.0).otherwise(0.5)).alias("d")).groupBy("f").agg(F.log(n / F.greatest(F.sum("d"), F.lit(1.0))).alias("idf"))
    vocab = cut(vocab.join(idf, "f").withColumn("idf", F.greatest("idf", F.lit(0.1))))
    most = math.log(n)
    if vocab.count() <= max_broadcast_words:
        vocab = F.broadcast(vocab)
    d = cut(staged(values.select("raw"), plain=_plain(F.col("raw"))).withColumn("ws", _words(F.col("plain"))))
    led = F.element_at(F.concat("ws", F.array(F.lit(""))), 1).isin(NEGATIONS)
    rest = F.when(led, F.slice("ws", 2, F.size("ws"))).otherwise(F.col("ws"))
    each = d.select("raw", F.explode(F.array_distinct(F.filter(rest, lambda x: ~x.isin(WEIGHTLESS + DOMAIN)))).alias("w"))
    affirm = entries.sparkSession.createDataFrame([(a,) for a in AFFIRMING], "v string")
    known = vocab.groupBy("v").agg(F.max("titled").alias("titled")).unionByName(affirm.withColumn("titled", F.lit(False)))
    known = known.groupBy("v").agg(F.max("titled").alias("titled"))
    # A value in one word looks for codes in one word, too, in case its spaces stand in the wrong places.
    whole = d.where(F.size("ws") > 1).select("raw", F.regexp_replace("plain", " ", "").alias("w"))
    fixed = cut(repair(each.select("w").unionByName(whole.select("w")).distinct(), known))
    yes = fixed.groupBy("w").agg(F.min(F.col("v").isin(AFFIRMING)).alias("affirms"))
    # What each distinct word gives to each entry, and the most it could give.
    gives = fixed.join(vocab, "v").groupBy("w", "entry").agg(F.max(F.col("sim") * F.col("idf") * F.col("weight")).alias("g"), F.max("in_code").alias("in_code"), F.max("idf").alias("idf"))
    other = 0.8 * most  # what a word weighs that is none of the entry's, at most
    worth = gives.groupBy("w").agg(F.least(F.max("idf"), F.lit(other)).alias("worth"))
    total = each.join(worth, "w", "left").join(yes, "w", "left").groupBy("raw").agg(F.sum(F.coalesce("worth", F.lit(other))).alias("total"), F.max(F.coalesce("affirms", F.lit(False))).alias("affirms"))
    size = F.size(_words(_plain(F.col("flag_code"))))
    codes = entries.select(F.col("flag_code").alias("entry"), size.alias("k"))
    # An entry that has none of a value's weightier words cannot reach the lowest score with the others: only the weightier
    # ones look for entries, so a word that very many entries have does not bring them all to every value that has it.
    most_of = gives.groupBy("w").agg(F.max(F.greatest("g", F.lit(0.0))).alias("gmax"))
    weighed = each.join(most_of, "w").join(total.select("raw", "total"), "raw")
    lighter = F.sum("gmax").over(Window.partitionBy("raw").orderBy("gmax", "w"))
    leads = weighed.withColumn("lighter", lighter).where(F.col("lighter") >= min(score, judged) * F.col("total") - 1e-9)
    met = leads.select("raw", "w").unionByName(whole).join(gives.select("w", "entry"), "w").select("raw", "entry").distinct()
    points = met.join(each, "raw").join(gives, ["w", "entry"]).groupBy("raw", "entry").agg(F.sum("g").alias("points"), F.sum(F.greatest(F.col("idf") - other, F.lit(0.0))).alias("extra"), F.count_if("in_code").alias("hit"))
    points = points.join(F.broadcast(codes) if n <= max_broadcast_words else codes, "entry").join(total, "raw")
    points = points.withColumns({"score": F.col("points") / (F.col("total") + F.col("extra")), "whole": F.least(F.col("hit") / F.col("k"), F.lit(1.0))})
    # A value that spells a whole code badly is compared with it as a whole, too.
    points = points.join(d.select("raw", F.regexp_replace("plain", " ", "").alias("joined")), "raw")
    code = F.translate(F.regexp_replace(F.lower("entry"), "[^a-z0-9]", ""), *_FOLD)
    typed = F.translate("joined", *_FOLD)
    alike = 1 - F.levenshtein(typed, code) / F.greatest(F.length(typed), F.length(code))
    points = points.withColumn("score", F.greatest("score", F.when(alike >= 0.8, alike).otherwise(0.0)))
    order = F.struct((F.col("score") + 0.05 * F.col("whole")).alias("s"), F.col("whole"), F.expr("transform(split(entry, ''), c -> -ascii(c))"))
    best = points.groupBy("raw").agg(F.max_by(F.struct("entry", "score", "whole"), order).alias("b"), F.first("affirms").alias("affirms"))
    out = d.join(best, "raw", "left")
    denied = led & (F.col("b.whole") >= 0.99)
    judges = F.exists("ws", lambda x: x.isin(JUDGING))
    ok = (F.col("b.score") >= F.when(judges, judged).otherwise(score)) & ~F.col("affirms") & ~denied
    return out.select("raw", F.when(ok, F.col("b.entry")).otherwise(F.lit(UNMATCHED)).alias("entry"))


def map_flags(results: DataFrame, catalogue: DataFrame, id_col: str = "result_id", flags_col: str = "flags", **kw) -> DataFrame:
    """(id_col, pos, flag_code): one row for every typed entry that is not null, blank or exactly a code."""
    codes = catalogue.where("flag_code is not null").select(F.col("flag_code").alias("raw")).distinct()
    each = results.select(id_col, F.posexplode(flags_col).alias("pos", "raw")).where(F.col("raw").rlike(r"[^\s 　]"))
    typed = each.join(codes, "raw", "left_anti")
    found = cut(match(typed.select("raw").distinct(), catalogue, **kw))
    return typed.join(found, "raw").select(id_col, "pos", F.col("entry").alias("flag_code"))
