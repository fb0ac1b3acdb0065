"""Linking variant spellings of company names on receipts.

The lines of a row are read as name, registration number and address. Name words fall into legal forms, trades (known
words, their abbreviations and misspellings) and own words; accents, case, punctuation and letters that scanners
confuse are made equal. Rows with equal readings are one record.

Candidates: names meet where a word of one, or two neighbours joined, or an end of a long word, is that of the other up to
one letter left out on either side (so up to an edit or a swap of neighbours). Of those that meet only names close as a
whole are verified. Records with equal registration numbers, and with like addresses, are candidates too.

Verification: the soft similarity of two names aligns own words by edit distance, in either order, joined or split,
and weighs them by rarity (trades and legal forms weigh nothing, single letters count as initials). It must reach
``similarity``. Short forms (one word and an initial, or the first letters of a word) link if the address or the trade
and initial agree and no second company fits as well. An equal registration number links by itself; an equal address
only if the names can be the same.

A line with a free-standing number is an address, unless no other line holds an own word and it shows no street word:
then it is the name, and the number an initial that the scanner misread, or part of the name.

Linked records form companies by connected components. Rows without an own word are linked by their registration number
if a trade stands beside it; otherwise they are in no pair. Null and empty arrays
and null entries are no lines. Repeated rows are each listed; extra columns are ignored.

Scale: everything before the last join works on distinct records; equal keys are linked to their smallest record, not
to each other. Only the distinct readings of one address and word beginning are all compared with each other. The list of all pairs of rows is asked for by the query and grows with the square of a company's rows;
``companies`` gives one row per row of the input instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.operators.graph import components
from tillscope.session import cut, staged

#: Lines that are no part of a name.
NOISE = r"OFFICIAL COPY|DUPLICATE|BIENVENIDO|SELAMAT DATANG|OPEN DAILY|WELCOME|TERIMA KASIH|THANK YOU|GRACIAS|TAX INVOICE|RECEIPT"
#: Legal forms.
LEGAL = "LTD LIMITED PTE SDN BHD SDNBHD SB GMBH SAS PL PTY PTELTD PTYLTD INC LLC CO PLC CORP AG KG SA SL SRL BV NV".split()
#: Trade words and what they stand for.
TRADES = {
    "SUPERMARKET": "SUPERMARKET", "SUPERMART": "SUPERMARKET", "SMARKET": "SUPERMARKET", "MINIMARKET": "MINIMARKET", "MINIMART": "MINIMARKET",
    "MMARKET": "MINIMARKET", "MINI": "MINIMARKET", "MARKET": "MINIMARKET", "BAKERY": "BAKERY", "HARDWARE": "HARDWARE", "PHARMACY": "PHARMACY",
    "RESTAURANT": "RESTAURANT", "RESTO": "RESTAURANT", "TRADING": "TRADING", "ELECTRICAL": "ELECTRICAL", "ELECTRIC": "ELECTRICAL",
    "STATIONERY": "STATIONERY", "STATIONERS": "STATIONERY", "AUTOPARTS": "AUTOPARTS", "APARTS": "AUTOPARTS", "AUTO": "AUTOPARTS",
    "PARTS": "AUTOPARTS", "HWARE": "HARDWARE", "ENTERPRISE": "ENTERPRISE", "BROTHERS": "BROTHERS", "BROS": "BROTHERS", "PANADERIA": "PANADERIA",
    "FERRETERIA": "FERRETERIA", "SHOP": "SHOP", "STORE": "SHOP", "STORES": "SHOP", "CAFE": "CAFE", "HOTEL": "HOTEL", "FARMACIA": "PHARMACY",
}
#: Words of addresses that are no street names.
STREET = "STREET|AVENUE|AVE|CALLE|LORONG|JALAN|LOT|LEVEL|SHOP|UNIT|SUITE|ROAD|NO"
_ADDRESS = r"\b(?:STREET|AVENUE|AVE|CALLE|LORONG|JALAN|LOT|LEVEL|UNIT|SUITE|ROAD)\b|\b(?:SHOP|NO)\b[. ]*[0-9]"
_ACCENTS = ("ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAAEEEEIIIIOOOOOUUUUNC")
#: Characters that scanners confuse in names.
_FOLD = ("0158264F", "OISBZGAE")
_REG = r"(?<![0-9A-Z])([0-9]{6}) ?-? ?([A-Z])(?![A-Z0-9])"
_NUMBER = r"(?<![A-Z0-9])[0-9]+(?:[/-][0-9]+)?(?![A-Z0-9])"
Q = 5


def _similar(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _trade(t: Column) -> Column:
    """The trade that a word stands for, or null: equal, misspelt, cut short, or with letters left out."""
    known = [(i, w.translate(str.maketrans(*_FOLD)), c) for i, (w, c) in enumerate(TRADES.items())]
    n = F.length(t)
    vowels = n - F.length(F.translate(t, "AEIOU", ""))
    spread = F.concat(F.lit("^"), F.regexp_replace(t, "(.)", "$1.*"))
    edits = lambda w: 2 if len(w) >= 9 else 1

    def listed(key: Column, groups: dict) -> Column:
        """The known words of a key's group; so that few are looked at."""
        entry = lambda i, w, c: F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(c).alias("c"))
        lists = [x for k, v in groups.items() if v for x in (F.lit(k), F.array(*[entry(*e) for e in v]))]
        return F.coalesce(F.element_at(F.create_map(*lists), key), F.array().cast("array<struct<i:int,w:string,c:string>>"))

    def begins(x: Column) -> Column:
        w, m = x["w"], F.length(x["w"])
        cut_short = (n >= 3) & F.startswith(w, t)
        # Short words hold the letters of many trades: they are one with no vowel after the first letter, or one letter short.
        bare = (n >= 5) | ~F.rlike(t, F.lit("^.+[AEIOU]")) | (m == n + 1)
        sparse = (n >= 3) & (vowels * 3 <= n) & (m > n) & bare & F.rlike(w, spread)
        return (t == w) | cut_short | sparse

    misspelt = lambda x: F.levenshtein(t, x["w"]) <= F.when(F.length(x["w"]) >= 9, 2).otherwise(1)
    letters = {a: [e for e in known if e[1][0] == a] for a in sorted({w[0] for _, w, _ in known})}
    lengths = {k: [e for e in known if len(e[1]) >= 5 and abs(len(e[1]) - k) <= edits(e[1])] for k in range(5, max(len(w) for _, w, _ in known) + 3)}
    hit = F.concat(F.filter(listed(F.left(t, F.lit(1)), letters), begins), F.filter(listed(n, lengths), misspelt))
    return F.array_min(hit)["c"]


def _tokens(line: Column) -> Column:
    """(w, c) of the words of a name: folded, with their trade."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"[./]", ""), r"\b(?:S A S)\b", "SAS"), r"\bG M B H\b", "GMBH")
    plain = F.regexp_replace(plain, r"['’]S\b", " ")
    plain = F.regexp_replace(plain, "(" + "|".join(sorted((t for t in TRADES if len(t) >= 6), key=len, reverse=True)) + ")", " $1 ")
    words = F.filter(F.split(plain, "[^A-Z0-9]+"), lambda w: (w != "") & ~w.isin(LEGAL))
    return F.transform(F.transform(words, lambda w: F.translate(w, *_FOLD)), lambda w: F.struct(w.alias("w"), F.when(F.length(w) >= 3, _trade(w)).alias("c")))


def _own(tokens: str) -> Column:
    return F.transform(F.filter(tokens, lambda x: (F.length(x["w"]) >= 2) & x["c"].isNull()), lambda x: x["w"])


def _street_line(x: Column) -> Column:
    """Whether a numbered line shows a street word, or a misspelt one and no trade or legal form."""
    streets = [w for w in STREET.split("|") if len(w) >= 5]
    marked = x.rlike(r"\b(?:" + "|".join(sorted({t for t in TRADES if t != "SHOP"} | {t for t in LEGAL if len(t) >= 3}, key=len, reverse=True)) + r")\b")
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    near = lambda w: reduce(lambda p, q: p | q, [(F.levenshtein(w, F.lit(t)) <= 1) | (letters(w) == "".join(sorted(t))) for t in streets])
    bent = F.exists(F.split(x, "[^A-Z0-9]+"), lambda w: (F.length(w) >= 4) & near(w))
    return x.rlike(_ADDRESS) | (bent & ~marked)


def records(rows: DataFrame, id_col: str = "ocr_id", lines_col: str = "company_lines") -> DataFrame:
    """(id_col, own, initials, trade, reg, street, numbers) of every row that shows a name, or a trade and a registration number."""
    upper = F.transform(F.filter(lines_col, lambda x: x.isNotNull()), lambda x: F.translate(F.regexp_replace(F.upper(x), r"\p{M}", ""), *_ACCENTS))
    d = staged(rows.select(id_col, lines_col), _l=upper).drop(lines_col)
    reg = F.regexp_extract(F.array_join("_l", "\n"), _REG, 0)
    name = lambda x: ~x.rlike(NOISE) & ~x.rlike(_REG) & x.rlike("[A-Z]")
    numbered = lambda x: ~x.rlike(_REG) & x.rlike(_NUMBER) & x.rlike("[A-Z]{3}")
    d = staged(d, reg=F.nullif(F.regexp_replace(reg, "[^0-9A-Z]", ""), F.lit("")), _n=F.filter("_l", lambda x: name(x) & ~x.rlike(_NUMBER)))
    d = staged(d, _first=_tokens(F.array_join("_n", " ")))
    # No own word in a line without a number: a numbered line that is no address is (part of) the name.
    d = staged(d, _m=F.when(F.size(_own("_first")) == 0, F.filter("_l", lambda x: numbered(x) & ~x.rlike(NOISE) & ~_street_line(x))).otherwise(F.array().cast("array<string>")))
    again = F.filter("_l", lambda x: F.array_contains("_m", x) | (name(x) & ~x.rlike(_NUMBER)))
    d = staged(d, _t=F.when(F.size("_m") > 0, _tokens(F.array_join(again, " "))).otherwise(F.col("_first")))
    d = staged(d, _a=F.element_at(F.concat(F.filter("_l", lambda x: numbered(x) & ~F.array_contains("_m", x)), F.array(F.lit(""))), 1))
    own = _own("_t")
    single = F.transform(F.filter("_t", lambda x: F.length(x["w"]) == 1), lambda x: x["w"])
    trade = F.element_at(F.concat(F.transform(F.filter("_t", lambda x: x["c"].isNotNull()), lambda x: x["c"]), F.array(F.lit(""))), 1)
    places = F.filter(F.split("_a", "[^A-Z]+"), lambda w: (F.length(w) >= 3) & ~w.rlike(f"^(?:{STREET})$"))
    street = F.element_at(F.concat(F.reverse(F.array_sort(F.transform(places, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("w")))), 1)["w"]
    numbers = F.array_join(F.regexp_extract_all("_a", F.lit("([0-9]+)"), 1), "-")
    d = d.select(id_col, own.alias("own"), single.alias("initials"), trade.alias("trade"), "reg", street.alias("street"), numbers.alias("numbers"))
    return d.where((F.size("own") > 0) | (F.col("reg").isNotNull() & (F.col("trade") != "")))


def _grams(own: Column) -> Column:
    padded = F.transform(own, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (Q - 1), F.lit(1))), lambda i: F.substring(p, i, Q)))
    return F.array_distinct(F.flatten(each))


def candidate_pairs(names: DataFrame, threshold: float = 0.12, similarity: float = 0.7) -> DataFrame:
    """(a, b), a < b, of names (id, own) that share a gram (q = 5) of both prefixes, and whose q-gram sets reach the Jaccard
    similarity or whose words in a row, or the beginning or end of the longer one, are close in edit distance.

    The prefix rows carry their sets and words, so a pair is checked where it meets; only similar ones leave the join. At a
    threshold this low the prefix is nearly the whole set, and pairs that meet grow as the square of the names: ``companies``
    uses ``word_pairs``.
    """
    sets = names.select("id", F.transform(_grams(F.col("own")), lambda x: F.xxhash64(x)).alias("g"), F.array_join("own", "").alias("s"), F.array_join(F.reverse("own"), "").alias("t"))
    g = sets.select("id", F.explode("g").alias("gram"))
    df = g.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = g.join(df, "gram").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "gram")))
    ranked = ranked.join(sets, "id").withColumn("n", F.size("g"))
    # A set of n grams shares at least ceil(t * n) with any that it resembles, so one of its first n - that + 1.
    prefix = cut(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("gram", "id", "n", "g", "s", "t"))
    x, y = _side(prefix, "a"), _side(prefix, "b")
    near = (F.col("id_a") < F.col("id_b")) & (F.col("n_a") * threshold <= F.col("n_b")) & (F.col("n_b") * threshold <= F.col("n_a"))
    common = F.size(F.array_intersect("g_a", "g_b"))
    sets_alike = common >= threshold * (F.col("n_a") + F.col("n_b") - common)
    sa, sb, ta = F.col("s_a"), F.col("s_b"), F.col("t_a")
    short, long = F.when(F.length(sa) <= F.length(sb), sa).otherwise(sb), F.when(F.length(sa) <= F.length(sb), sb).otherwise(sa)
    n = F.length(short)
    ends_alike = (_similar(short, F.left(long, n)) >= similarity) | (_similar(short, F.right(long, n)) >= similarity)
    alike = sets_alike | (_similar(sa, sb) >= similarity) | (_similar(ta, sb) >= similarity) | ((n >= 5) & ends_alike)
    met = x.join(y, F.col("gram_a") == F.col("gram_b")).where(near).where(alike)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _shorter(w: Column, least: int = 5) -> Column:
    """A word and all that one letter left out makes of it: two words one edit, or two swapped letters, apart share one."""
    n = F.length(w)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, n)))
    return F.when(n >= least, F.concat(F.array(w), each)).otherwise(F.array(w))


def _meeting_keys(own: Column) -> Column:
    """(word, key) of the words of a name, of neighbours joined, and of the ends of long words, with a letter left out; hashes."""
    none = F.array().cast("array<string>")
    joined = F.when(F.size(own) > 1, F.transform(F.slice(own, 2, F.size(own)), lambda w, i: F.concat(F.element_at(own, i + 1), w))).otherwise(none)
    # Two whole words joined meet others as beginning and end of theirs.
    words = F.filter(F.array_distinct(F.concat(own, F.filter(joined, lambda w: F.length(w) <= 10))), lambda w: F.length(w) >= 4)
    # A long word may be two in one, or hold letters of the next: its beginnings and ends, and the name's, are what the words of others are.
    long = F.filter(own, lambda w: F.length(w) >= 9)
    long = F.when((F.size(long) > 0) & (F.size(own) > 1), F.concat(long, F.array(F.array_join(own, "")))).otherwise(long)
    cuts = lambda w: F.transform(F.sequence(F.lit(5), F.least(F.length(w) - 1, F.lit(10))), lambda n: F.array(F.left(w, n), F.right(w, n)))
    ends = F.array_except(F.flatten(F.flatten(F.transform(long, cuts))), words)
    hashed = lambda least: lambda w: F.transform(F.array_distinct(_shorter(w, least)), lambda v: F.struct(F.xxhash64(w).alias("word"), F.xxhash64(v).alias("key")))
    return F.flatten(F.concat(F.transform(words, hashed(5)), F.transform(ends, hashed(6))))


def word_pairs(names: DataFrame, similarity: float = 0.7) -> DataFrame:
    """(a, b), a < b, of names (id, own, wt, ini) that can be one: a word of both is equal but for a letter left out of each,
    and the words in a row, in either order, are close in edit distance; or the beginning or end of the longer name, if
    just one has initials; or one name can do without a word, since it weighs no more than a quarter; or both have three words.
    """
    total = F.aggregate("wt", F.lit(0.0), lambda acc, x: acc + x)
    # One short word without an initial can be no name's equal.
    able = F.col("ini") | (F.length("s") >= 9)
    sets = names.withColumns({"s": F.array_join("own", ""), "t": F.array_join(F.reverse("own"), ""), "loose": (F.size("own") > 1) & (F.array_min("wt") <= total / 4), "many": F.size("own") > 2}).where(able)
    keys = sets.select("id", "s", "t", "ini", "loose", "many", F.explode(_meeting_keys(F.col("own"))).alias("k")).select("*", "k.*").drop("k")
    x, y = _side(keys, "a"), _side(keys, "b")
    sa, sb = F.col("s_a"), F.col("s_b")
    most = f"cast(greatest(octet_length(s_a), octet_length(s_b)) * {1 - similarity} + 1e-9 as int)"
    close = lambda p, q: F.expr(f"levenshtein({p}, {q}, {most}) >= 0")
    short, long = F.when(F.length(sa) <= F.length(sb), sa).otherwise(sb), F.when(F.length(sa) <= F.length(sb), sb).otherwise(sa)
    n = F.length(short)
    ends_alike = (_similar(short, F.left(long, n)) >= similarity) | (_similar(short, F.right(long, n)) >= similarity)
    alike = F.col("loose_a") | F.col("loose_b") | (F.col("many_a") & F.col("many_b")) | close("s_a", "s_b") | close("t_a", "s_b") | close("s_a", "t_b") | ((F.col("ini_a") != F.col("ini_b")) & ends_alike)
    # Equal words share every key; they meet at the whole word only.
    once = (F.col("word_a") != F.col("word_b")) | (F.col("word_a") == F.col("key_a"))
    met = x.join(y, F.col("key_a") == F.col("key_b")).where(F.col("id_a") < F.col("id_b")).where(once & alike)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _side(d: DataFrame, s: str) -> DataFrame:
    return d.select(*[F.col(c).alias(f"{c}_{s}") for c in d.columns])


def soft_similarity(a: Column, b: Column, wa: Column) -> Column:
    """Own words of ``a`` found in ``b`` by edit distance, weighted by rarity; words of ``b`` may be joined."""
    joined = F.transform(F.slice(b, 2, F.size(b)), lambda w, i: F.concat(F.element_at(b, i + 1), w))
    pool = F.concat(b, F.when(F.size(b) > 1, joined).otherwise(F.array().cast("array<string>")))

    def best(w: Column) -> Column:
        s = F.array_max(F.transform(pool, lambda v: _similar(w, v)))
        return F.when(s >= 0.6, s).otherwise(0.0)

    found = F.aggregate(F.arrays_zip(a.alias("w"), wa.alias("x")), F.lit(0.0), lambda acc, p: acc + p["x"] * best(p["w"]))
    total = F.aggregate(wa, F.lit(0.0), lambda acc, x: acc + x)
    return found / F.greatest(total, F.lit(1e-9))


def companies(rows: DataFrame, id_col: str = "ocr_id", lines_col: str = "company_lines", similarity: float = 0.75, use_registration: bool = True, use_places: bool = True, with_links: bool = False) -> DataFrame:
    """(id_col, company): one row for every row that shows a name; the company is its smallest record.

    ``with_links`` adds links: how many other records its record is directly linked with. Without ``use_registration`` and
    ``use_places`` names alone link: no registration number, no address, and no short form that needs them.
    """
    keys = ["own", "initials", "trade", "reg", "street", "numbers"]
    r = cut(records(rows, id_col, lines_col))
    flat = [F.array_join("own", " ").alias("k_own"), F.array_join("initials", " ").alias("k_in"), "trade", F.coalesce("reg", F.lit("")).alias("k_reg"), "street", "numbers"]
    r = r.withColumn("key", F.xxhash64(*[c if not isinstance(c, str) else F.col(c) for c in flat]))
    rec = cut(r.groupBy("key").agg(F.min(id_col).alias("id"), *[F.first(k).alias(k) for k in keys]))
    member = r.select(id_col, "key").join(rec.select("key", "id"), "key").select(id_col, "id")

    # Names: distinct lists of own words and initials with their trade.
    rec = staged(rec, name=F.concat_ws("|", F.array_join("own", " "), F.array_join("initials", " "), "trade"))
    names = rec.groupBy("name").agg(F.min("id").alias("nid"), F.first("own").alias("own"), F.first("initials").alias("initials"), F.first("trade").alias("trade"), *_marks())
    tokens = names.select("nid", F.posexplode("own").alias("p", "w"))
    total = F.lit(float(max(names.count(), 1)))
    idf = tokens.groupBy("w").agg(F.log(1 + total / F.countDistinct("nid")).alias("x"))
    weights = tokens.join(idf, "w").groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("wt"))
    names = cut(names.join(weights, "nid"))

    pairs = word_pairs(names.select(F.col("nid").alias("id"), "own", "wt", (F.size("initials") > 0).alias("ini")))
    v = pairs.join(_side(names, "a"), F.col("a") == F.col("nid_a")).join(_side(names, "b"), F.col("b") == F.col("nid_b"))
    whole = lambda s: F.array_join(f"own_{s}", "")
    back = lambda s: F.array_join(F.reverse(f"own_{s}"), "")
    direct = F.greatest(_similar(whole("a"), whole("b")), _similar(back("a"), whole("b")), _similar(whole("a"), back("b")))
    long_ = (F.length(whole("a")) >= 9) & (F.length(whole("b")) >= 9)
    both = F.least(soft_similarity(F.col("own_a"), F.col("own_b"), F.col("wt_a")), soft_similarity(F.col("own_b"), F.col("own_a"), F.col("wt_b")))
    same_trade = (F.col("trade_a") == F.col("trade_b")) | (F.col("trade_a") == "") | (F.col("trade_b") == "")
    full = long_ & ((direct >= similarity) | (both >= similarity)) & ((F.size("own_a") > 1) | (F.size("own_b") > 1) | (direct >= 0.85))

    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    near = lambda w, y: (_similar(w, y) >= 0.8) | ((F.length(w) >= 6) & (F.levenshtein(w, y) == 2) & (letters(w) == letters(y)))

    def initial(short: str, long: str) -> Column:
        """One word (maybe split) and an initial against two words (maybe joined), in either order."""
        w, x, n = whole(short), whole(long), F.length(whole(short))
        ini = F.col(f"initials_{short}")
        front = near(w, F.left(x, n)) & F.exists(ini, lambda i: F.contains(F.substring(x, n, 3), i))
        rear = near(w, F.right(x, n)) & F.exists(ini, lambda i: F.startswith(x, i))
        return (n >= 5) & (F.size(ini) > 0) & (F.size(f"initials_{long}") == 0) & (F.length(x) >= n + 3) & (front | rear)

    alike = (F.size("own_a") == 1) & (F.size("own_b") == 1) & (F.size(F.array_intersect("initials_a", "initials_b")) > 0)
    alike = alike & (_similar(whole("a"), whole("b")) >= 0.85) & (F.col("trade_a") == F.col("trade_b")) & (F.col("trade_a") != "")
    short = same_trade & (initial("a", "b") | initial("b", "a"))
    # Different registration numbers keep names apart; different house numbers keep short forms apart.
    edges = [v.where(~_clash("reg") & (full | ((short | alike) & ~_clash("num")))).select("a", "b")]
    # Equal names, and equal registration numbers, are linked to their smallest record.
    edges.append(rec.join(names.select("name", "nid", F.size("own").alias("k"), F.size("initials").alias("ki"), "reg_lo", "reg_hi", "num_lo", "num_hi"), "name").where("k > 1 or (ki > 0 and trade <> '' and coalesce(reg_lo = reg_hi, true) and coalesce(num_lo = num_hi, true))").select(F.col("id").alias("a"), F.col("nid").alias("b")))
    if use_registration:
        regs = rec.where("reg is not null")
        edges.append(regs.join(regs.groupBy("reg").agg(F.min("id").alias("b")), "reg").select(F.col("id").alias("a"), "b"))
    if use_places:
        edges.append(_same_place(rec))
    edges.append(rec.select(F.col("id").alias("a"), F.col("id").alias("b")))
    links = reduce(DataFrame.unionByName, edges)
    if with_links:
        links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = cut(components(links))
    if use_places:
        linked = _short_forms(rec, linked)
    out = member.join(linked.select(F.col("node").alias("id"), "component"), "id").select("id", id_col, F.col("component").alias("company"))
    if with_links:
        ends = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        out = out.join(ends, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return out.drop("id")


def _marks() -> list[Column]:
    """The least and greatest registration and house numbers of a group; equal if it has but one."""
    num = F.nullif("numbers", F.lit(""))
    return [F.min("reg").alias("reg_lo"), F.max("reg").alias("reg_hi"), F.min(num).alias("num_lo"), F.max(num).alias("num_hi")]


def _clash(kind: str, a: str = "a", b: str = "b") -> Column:
    """Whether both sides have but one number each, and different ones."""
    lo, hi = (lambda s: F.col(f"{kind}_lo_{s}")), (lambda s: F.col(f"{kind}_hi_{s}"))
    return F.coalesce((lo(a) == hi(a)) & (lo(b) == hi(b)) & (lo(a) != lo(b)), F.lit(False))


def _same_place(rec: DataFrame) -> DataFrame:
    """Links of records with like addresses whose names can be the same."""
    p = rec.where((F.length("street") >= 4) & (F.col("numbers") != ""))
    p = p.select("id", "own", "initials", "trade", "street", "numbers").withColumn("stem", F.explode(F.array_distinct(F.transform("own", lambda w: F.substring(w, 1, 3)))))
    # Address and beginning of a word are one key; within it every two different readings are compared.
    p = p.withColumn("end", F.explode(F.array(F.substring("street", 1, 3), F.expr("right(street, 3)"))))
    key, read = ["numbers", "stem", "end"], ["street", "own"]
    low = cut(p.groupBy(*key, *read).agg(F.min("id").alias("id")))
    x, y = (low.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ["id", *read]]) for s in "ab")
    near = _similar(F.col("street_a"), F.col("street_b")) >= 0.7
    # Two whole names that differ are two companies in one place.
    wa, wb = F.array_join("own_a", ""), F.array_join("own_b", "")
    # Either side may be the reversed one: of a split word and its whole only one reversal keeps the letters in order.
    like = F.greatest(_similar(wa, wb), _similar(F.array_join(F.reverse("own_a"), ""), wb), _similar(wa, F.array_join(F.reverse("own_b"), "")))
    near = near & ((F.size("own_a") < 2) | (F.size("own_b") < 2) | (like >= 0.6))
    met = x.join(y, key).where((F.col("id_a") < F.col("id_b")) & near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # Records of one reading are linked to their smallest.
    same = p.join(low.withColumnRenamed("id", "b"), [*key, *read]).where("id <> b").select(F.col("id").alias("a"), "b")
    return met.unionByName(same).distinct()


def _short_forms(rec: DataFrame, linked: DataFrame) -> DataFrame:
    """Attach records that show only the beginning of a word, where exactly one company fits."""
    r = rec.join(linked, rec["id"] == linked["node"])
    w = F.get("own", 0)
    # Four letters, or four and a Y, alone or with an initial; so far linked to no longer name.
    longest = r.groupBy("component").agg(F.max(F.when(F.size("own") > 1, 1).otherwise(0)).alias("has_full"), *_marks())
    r = cut(r.select("id", "own", "initials", "trade", "component").join(longest, "component"))
    marks = ["reg_lo", "reg_hi", "num_lo", "num_hi"]
    nick = (F.size("own") == 1) & ((F.length(w) == 4) | ((F.length(w) == 5) & (F.substring(w, 5, 1) == "Y")))
    loose = r.where("has_full = 0").where(nick | ((F.size("own") == 1) & (F.length(w) >= 5)))
    loose = loose.select("id", F.col("component").alias("own_component"), F.when(nick, F.substring(w, 1, 4)).otherwise(w).alias("stem"), F.element_at(F.concat("initials", F.array(F.lit(""))), 1).alias("ini"), "trade", *[F.col(m).alias(f"{m}_a") for m in marks])
    full = r.where("has_full = 1").where(F.size("own") > 1)
    full = full.select("component", "trade", F.posexplode("own").alias("p", "x"), "own", *[F.col(m).alias(f"{m}_b") for m in marks])
    other = F.array_join(F.transform(F.filter("own", lambda y: y != F.col("x")), lambda y: F.substring(y, 1, 1)), "")
    full = full.select("component", "trade", other.alias("others"), *[f"{m}_b" for m in marks], F.explode(F.array_distinct(F.array(F.substring("x", 1, 4), F.col("x")))).alias("stem")).distinct()
    hit = loose.join(full.withColumnRenamed("trade", "full_trade"), "stem")
    fits = ((F.col("ini") == "") | F.contains("others", F.col("ini"))) & ((F.col("trade") == "") | (F.col("full_trade") == "") | (F.col("trade") == F.col("full_trade")))
    known = (F.col("ini") != "") | (F.col("trade") != "")
    hit = hit.where(fits & known & ~_clash("reg") & ~_clash("num")).groupBy("id").agg(F.min("component").alias("to"), F.count_distinct("component").alias("k"), F.first("own_component").alias("own_component"))
    moves = hit.where("k = 1").groupBy("own_component").agg(F.min("to").alias("to"), F.count_distinct("to").alias("k")).where("k = 1")
    out = linked.join(moves, linked["component"] == moves["own_component"], "left")
    return out.select("node", F.coalesce("to", "component").alias("component"))


def pairs(rows: DataFrame, id_col: str = "ocr_id", **kw) -> DataFrame:
    """(id_col_a, id_col_b), a < b: every pair of rows of one company."""
    c = cut(companies(rows, id_col, **kw))
    x, y = c.select("company", F.col(id_col).alias(f"{id_col}_a")), c.select("company", F.col(id_col).alias(f"{id_col}_b"))
    return x.join(y, "company").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")
