"""Defects of prompt and response pairs: empty, truncated, refusal, copy, language.

What a response says is taken from the reasons that its raw text really contains (a failed call's stand-in reasons do
not count), else from the raw text from its first brace on, without JSON keys.

* ``copy``: the word trigrams of what is said are contained in the prompt's (``containment``), and the longest common
  subsequence of both token lists covers as much of it. A quoted line before an answer is no part of what is said.
* ``refusal``: a sentence aligns with a refusal template: their longest common subsequence covers ``alignment`` of the
  template, and the answer gives no verdict but UNCERTAIN.
* ``truncated``: an unclosed object, prose without a closing mark, or a cut mark; or a reason that breaks off. A
  reason without a closing mark breaks off if it ends with a word that cannot end a sentence, or if the corpus holds
  a longer reason that continues it (numbers are taken as equal). So reasons that are only typed without a full stop
  are left alone.
* ``language``: the reasons have more function words, or letters of a script, of another language than the prompt's.

A result has at most one defect, the first that fits of: empty, copy, refusal, truncated, language. Null and blank
responses are empty. A result whose prompt is missing or null can be neither copy nor language. Repeated result rows
are each reported; prompts repeated under one id count once. Bad formatting alone is no defect.

Scale: one join on prompt_id. Shingles and all patterns are SQL expressions; the alignments run in an Arrow function,
for the few rows that the cheap measures leave open. Continuations are found among the distinct forms of reasons, by
range partitioning and a look at the next form, so a common opening makes no hot group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import cut, let, staged

#: Refusal templates, in words.
REFUSALS = [
    "i'm sorry but i can't help with", "i cannot help with", "i can't assist with", "i cannot assist with this request",
    "i am unable to assess", "i am unable to provide", "i'm unable to", "i am not able to", "i won't be able to give",
    "i must decline to", "i have to decline", "i refuse to", "goes against my guidelines", "against my policy",
    "do not have the ability to", "i don't have the ability to", "something i have to leave to others", "i cannot give a verdict",
    "as an ai i cannot", "no assessment will be given", "lo siento no puedo", "no me es posible emitir", "debo negarme a",
    "no puedo ayudar con", "va en contra de mis normas", "maaf saya tidak dapat", "saya tidak boleh memberi",
    "bercanggah dengan garis panduan saya", "saya tidak dapat membantu", "je suis désolé je ne peux pas", "je ne peux pas",
    "es tut mir leid ich kann nicht", "ich kann dazu keine", "desculpe não posso", "não posso ajudar com",
]
#: Function words that tell the languages apart.
WORDS = {
    "en": "the of is and to are in not with from than an at by this between that on for be i my you was",
    "es": "el la los las del en se es al por una un con y está más que coincide ven dos esta lo su para",
    "ms": "yang dan di ini tidak untuk pada dengan dalam lebih ialah dua kali sebanyak berada tiada kesan sekitar dari adalah itu",
    "fr": "le les une du est des l aucun deux n même près aux la et dans pour sur pas ne un",
    "de": "der die das ist ein alle haben zu keine rund um den und nicht mit von dieselbe im des",
    "pt": "o os as do da dos não há com mesma uma no duas à pelo ao em itens a e",
}
#: Words that cannot end a sentence.
DANGLING = "and or the a an of to which that with in on for is are by from at y o la el los las un una de del que con en por para dan yang atau di ke untuk pada dengan dari et ou le les und oder der die das mit e ou da do com"
_CLOSED = r"[.!?。！？।…؟][\"'”’»)\]」』]*$"
_CUT = r"(?i)(\.\.\.|…|\[(cut|truncated|cut off|snip)\])$"
_NOTHING = ["json", "null", "none", "nil", "n", "a"]


def _words(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """A 64-bit value for every run of three words (of one or two, if there are no more)."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.array_distinct(F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>")))


def _hits(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(WORDS[lang].split())))


def language(text: Column, words: Column, default: Column) -> Column:
    """The language of a text and its lower-case words; of equal counts ``default``, also where nothing speaks for any."""
    scripts = {"zh": r"\p{IsHan}", "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "th": r"\p{IsThai}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}", "el": r"\p{IsGreek}", "ru": r"\p{IsCyrillic}"}
    foreign = F.regexp_count(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]"))
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}+"))
    script = reduce(lambda acc, k: F.when(text.rlike(scripts[k]), k).otherwise(acc), reversed([k for k in scripts if k != "zh"]), F.lit("zh"))
    counts = {k: _hits(words, k) for k in WORDS}
    top = F.greatest(*counts.values())
    own = reduce(lambda acc, k: F.when(default == k, counts[k]).otherwise(acc), counts, F.lit(0))
    best = reduce(lambda acc, k: F.when(counts[k] == top, k).otherwise(acc), reversed(list(counts)), F.lit(None).cast("string"))
    return F.when(foreign > latin, script).when((top == 0) | (own == top), default).otherwise(best)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine word operation per element of b (Hyyrö's bit vectors)."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def alignments(templates: list[str]):
    """An Arrow function of (parts, prompt, said), any of them null where its measure is not asked for.

    aligned: the share of the parts' tokens that common subsequences of each part and the prompt cover.
    refused: the best cover of a refusal template by one of the sentences of what is said.
    """
    split = [t.split() for t in templates]

    bags = [(t, set(t)) for t in split]

    def refusal(s: str) -> float:
        words = re.findall(r"[\w']+", s)
        have, best = set(words), 0.0
        for t, bag in bags:
            # A subsequence has no more of a template than the words they share.
            if (len(bag & have) + len(t) - len(bag)) / len(t) > best:
                # Other words may stand between those of the template, anywhere in the sentence.
                best = max(best, lcs(t, words) / len(t))
        return best

    @F.pandas_udf("aligned double, refused double")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for parts, prompts, said in batches:
            aligned, refused = [0.0] * len(said), [0.0] * len(said)
            for k, p in enumerate(parts):
                if p is not None:
                    own = [_tokens(x) for x in p if x]
                    n, whole = sum(map(len, own)), _tokens(prompts.iloc[k] or "")
                    aligned[k] = sum(lcs(x, whole) for x in own) / n if n else 0.0
            for k, text in enumerate(said):
                if text is not None:
                    for s in re.split(r"[.!?。！？\n]+", text.lower().replace("’", "'")):
                        if s not in known:
                            if len(known) > 50_000:
                                known.clear()
                            known[s] = refusal(s)
                        refused[k] = max(refused[k], known[s])
            yield pd.DataFrame({"aligned": aligned, "refused": refused})

    return measure


def form(reason: Column) -> Column:
    """A reason with its numbers made equal."""
    return F.regexp_replace(F.trim(reason), r"[0-9]+([.,/:-][0-9]+)*", "#")


def _dangling(s: Column) -> Column:
    return F.lower(s).rlike(r"(?:^|[ ,])(?:" + "|".join(DANGLING.split()) + r")$")


def broken_forms(forms: DataFrame, partitions: int | None = None) -> DataFrame:
    """(form) of those forms without a closing mark that break off, from distinct (form)."""
    spark = forms.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = forms.where(~_dangling(F.col("form")))
    ranged = cut(whole.repartitionByRange(n, "form").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("form").alias("first"))
    order = Window.orderBy("part")  # one row per partition
    firsts = firsts.select("part", F.lead("first").over(order).alias("beyond"))
    nexts = ranged.withColumn("next", F.lead("form").over(Window.partitionBy("part").orderBy("form")))
    nexts = nexts.join(F.broadcast(firsts), "part", "left").withColumn("next", F.coalesce("next", "beyond"))
    tail = F.substring(F.col("next"), F.length("form") + 1, F.length("next"))
    goes_on = F.startswith(F.col("next"), F.col("form")) & tail.rlike(r"[\p{L}\p{N}]")
    open_ = ~F.col("form").rlike(_CLOSED)
    return nexts.where(open_ & goes_on).select("form").unionByName(forms.where(open_ & _dangling(F.col("form"))).select("form"))


def defects(results: DataFrame, prompts: DataFrame, containment: float = 0.6, alignment: float = 0.8) -> DataFrame:
    """(result_id, defect) of every defective result."""
    r = results.select("result_id", "prompt_id", F.trim("raw_response").alias("raw"), F.upper(F.trim("label")).alias("label"), "reasons")
    given = F.filter("reasons", lambda x: x.isNotNull() & (F.trim(x) != "") & F.contains(F.col("raw"), x))
    r = staged(r, given=F.coalesce(given, F.array().cast("array<string>")), body=F.when(F.instr("raw", "{") > 0, F.substring(F.col("raw"), F.instr("raw", "{"), F.length("raw"))).otherwise(F.col("raw")))

    cut_off = F.filter("given", lambda x: F.trim(x).rlike(_CUT))
    open_ = F.filter("given", lambda x: ~F.trim(x).rlike(_CLOSED))
    forms = cut(r.select(F.explode("given").alias("reason")).select(form(F.col("reason")).alias("form")).distinct())

    p = prompts.select("prompt_id", "prompt", "prompt_lang").dropDuplicates(["prompt_id"])
    j = r.drop("reasons").join(p, "prompt_id", "left")
    keys = r"""["'][a-z_]+["']\s*:|```(?:json)?"""
    content = F.regexp_replace("body", keys, " ")
    said = F.when(F.size("given") > 0, F.array_join("given", " ")).otherwise(content)
    j = staged(j, said=F.coalesce(said, F.lit("")), marked=F.size(cut_off) > 0, open=F.transform(open_, form))
    j = staged(j, w=_words(F.col("said")), pw=_words(F.coalesce("prompt", F.lit(""))))
    inside = let(_shingles(F.col("w")), lambda sh: F.size(F.array_intersect(sh, _shingles(F.col("pw")))) / F.greatest(F.size(sh), F.lit(1)))
    j = staged(
        j,
        blank=F.size(F.filter("w", lambda x: ~x.isin(_NOTHING))) == 0,
        inside=inside,
        verdict=(F.size("given") > 0) & F.col("label").isin("REAL", "FAKE"),
        torn=_torn(F.col("raw"), F.col("body")),
        tongue=F.coalesce("prompt_lang", F.when(F.col("prompt").isNotNull(), language(F.col("prompt"), F.col("pw"), F.lit("en")))),
    )
    # The alignments are only asked for where they can matter; elsewhere the functions see nulls.
    maybe_copy = (F.col("inside") >= containment) & ~F.col("blank")
    parts = F.when(F.size("given") > 0, F.col("given")).otherwise(F.array("said"))
    own = reduce(lambda acc, k: F.when(F.col("tongue") == k, _hits(F.col("w"), k)).otherwise(acc), WORDS, F.lit(0))
    sure = own >= F.greatest(F.lit(2), F.size("w") * 0.2)
    other = F.when(F.col("tongue").isNull() | sure, False).otherwise(language(F.col("said"), F.col("w"), F.col("tongue")) != F.col("tongue"))
    # From here on a row has few values, and texts only where an alignment is asked for.
    lite = j.select(
        "result_id", "blank", F.when(~F.col("blank"), F.col("open")).alias("open"), (F.col("torn") | F.col("marked")).alias("torn"), other.alias("other"),
        F.when(maybe_copy, parts).alias("a"), F.when(maybe_copy, F.col("prompt")).alias("b"), F.when(~F.col("verdict") & ~F.col("blank"), F.col("said")).alias("c"),
    )
    lite = cut(lite)
    late = F.when(F.col("torn"), "truncated")
    wanted = F.col("a").isNotNull() | F.col("c").isNotNull()
    asked = lite.where(wanted).withColumn("found", alignments(REFUSALS)("a", "b", "c"))
    copied, refused = F.col("a").isNotNull() & (F.col("found.aligned") >= containment), F.col("c").isNotNull() & (F.col("found.refused") >= alignment)
    asked = cut(asked.select("result_id", F.when(copied, "copy").when(refused, "refusal").otherwise(late).alias("early"), "other", "open"))
    plain = lite.where(~wanted).select("result_id", F.when(F.col("blank"), "empty").otherwise(late).alias("early"), "other", "open")
    j = plain.unionByName(asked).withColumn("open", F.when(F.col("early").isNull(), F.col("open")))
    off = j.select(F.col("result_id").alias("_id"), F.explode("open").alias("form")).join(broken_forms(forms), "form").select("_id").distinct()
    j = j.join(off.withColumn("off", F.lit(True)), F.col("result_id") == F.col("_id"), "left")
    defect = F.coalesce("early", F.when(F.col("off"), "truncated"), F.when(F.col("other"), "language"))
    return j.select("result_id", defect.alias("defect")).where("defect is not null")


def _torn(raw: Column, body: Column) -> Column:
    """Whether the raw text breaks off."""

    def count(c: str) -> Column:
        return F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))

    unclosed = (count("{") > count("}")) | (count("[") > count("]"))
    return F.when(raw.rlike(_CUT), True).when(F.instr(raw, "{") > 0, unclosed).otherwise(~raw.rlike(_CLOSED))
