import random

import pytest
from pyspark.sql import functions as F

from tillscope.llm import consensus, names, pairs, sentences, tokenizer, vocabulary

RESULTS = "result_id long, prompt_id long, attempt int, judge_id string, receipt_id string, label string, confidence double, reasons array<string>, flags array<string>, raw_response string, parse_error string, judged_at timestamp, n int, x string, y string"


def results(spark, rows):
    """rows: dicts over defaults; n, x and y are extra columns with clashing names."""
    base = {"prompt_id": None, "attempt": 1, "judge_id": None, "receipt_id": None, "label": None, "confidence": None, "reasons": None, "flags": None, "raw_response": None, "parse_error": None, "judged_at": None, "n": 1, "x": "x", "y": "y"}
    names_ = [c.split(" ")[0] for c in RESULTS.split(", ")]
    return spark.createDataFrame([tuple(({"result_id": i} | base | r)[c] for c in names_) for i, r in enumerate(rows)], RESULTS)


# --- consensus --------------------------------------------------------------------------------------------------------


def judged(n_items=120, seed=1):
    """Five good judges, one that inverts, one that always says REAL; the truth with them."""
    rng = random.Random(seed)
    truth = {f"r{i}": rng.choice(["REAL", "FAKE"]) for i in range(n_items)}
    other = {"REAL": "FAKE", "FAKE": "REAL"}
    rows = []
    for r, t in truth.items():
        for j in rng.sample(range(7), 5):
            v = t if j < 5 else other[t] if j == 5 else "REAL"
            if j < 5 and rng.random() < 0.1:
                v = other[t]
            rows.append({"receipt_id": r, "judge_id": f"j{j}", "label": rng.choice([v, v.lower(), f" {v} "]), "confidence": 80.0, "reasons": ["a", "b"]})
    return truth, rows


def test_consensus_finds_truth_and_worth(spark):
    truth, rows = judged()
    items, judges, sweeps, moved = consensus.consensus(results(spark, rows))
    assert sweeps > 1 and moved < 1e-3
    got = {r.receipt_id: r.label for r in items.collect()}
    assert sum(got[k] == v for k, v in truth.items()) >= 0.97 * len(truth)
    worth = {r.judge_id: r for r in judges.collect()}
    assert worth["j5"].reliability[0] < 0 < min(worth[f"j{k}"].reliability[0] for k in range(5)) and worth["j5"].accuracy < 0.2


def test_unfinished_loops_are_reported(spark):
    from tillscope.operators.graph import components

    edges = results(spark, judged()[1]).select("receipt_id", "judge_id", F.trim(F.upper("label")).alias("label"))
    with pytest.raises(RuntimeError):
        consensus.message_passing(edges, max_iter=1)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), max_rounds=1)


def test_consensus_without_broadcast_is_the_same(spark):
    _, rows = judged(40)
    e = consensus.votes(results(spark, rows), ("REAL", "FAKE", "UNCERTAIN"))
    a = {r.receipt_id: r.label for r in consensus.message_passing(e)[0].collect()}
    assert a == {r.receipt_id: r.label for r in consensus.message_passing(e, max_broadcast_annotators=2)[0].collect()}


def test_consensus_of_nothing_and_of_numbered_ids(spark):
    none = consensus.consensus(results(spark, [{"receipt_id": "a"}]))
    assert [tuple(r) for r in none.items.select("receipt_id", "label", "n_votes").collect()] == [("a", "UNCERTAIN", 0)] and none.annotators.count() == 0
    for most in (9, 1):
        empty = consensus.message_passing(spark.createDataFrame([], "receipt_id long, judge_id int, label string"), max_broadcast_annotators=most)
        assert (empty.items.count(), empty.annotators.count(), empty.sweeps) == (0, 0, 0)
        e = spark.createDataFrame([(i, j, "REAL" if (i + (j == 3)) % 2 else "FAKE") for i in range(30) for j in range(4)], "receipt_id long, judge_id int, label string")
        got = consensus.message_passing(e, max_broadcast_annotators=most)
        assert {r.receipt_id: r.label for r in got.items.collect()} == {i: "REAL" if i % 2 else "FAKE" for i in range(30)}
        assert {r.judge_id: r.accuracy for r in got.annotators.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}


def test_consensus_unusable_and_repeated(spark):
    ok = {"receipt_id": "a", "judge_id": "j", "reasons": ["x"], "confidence": 50.0}
    rows = [ok | {"label": "REAL", "attempt": 1}, ok | {"label": "FAKE", "attempt": 2}, ok | {"label": "FAKE", "attempt": 2}, ok | {"label": "UNCERTAIN", "confidence": 0.0, "attempt": 3}, {"receipt_id": "b", "judge_id": "j", "label": "REAL"}, {"receipt_id": "c"}, {"label": "REAL", "reasons": ["x"]}]
    got = {r.receipt_id: (r.label, r.n_votes, r.agreement) for r in consensus.consensus(results(spark, rows))[0].collect()}
    assert got == {"a": ("FAKE", 1, 1.0), "b": ("UNCERTAIN", 0, None), "c": ("UNCERTAIN", 0, None)}


# --- vocabulary -------------------------------------------------------------------------------------------------------

FLAGS = {
    "total mismatch": "TOTAL_MISMATCH", "TOTAL_M15MATCH": "TOTAL_MISMATCH", "mismatch, total": "TOTAL_MISMATCH", "totalmismatch!!": "TOTAL_MISMATCH", "sum doesn't add up": "TOTAL_MISMATCH", "total_mismatch (see total)": "TOTAL_MISMATCH",
    "pymt. incons": "PAYMENT_INCONSISTENCY", "impl. date": "IMPLAUSIBLE_DATE", "copy paste artfct": "COPY_PASTE_ARTIFACT", "shop doesn't exist": "IMPLAUSIBLE_STORE", "fuente inconsistente": "FONT_INCONSISTENCY", "Ralat cukai": "TAX_ERROR",
    "resoultion_mismatch": "RESOLUTION_MISMATCH", "date is plausible": "UNMATCHED", "font consistent": "UNMATCHED", "no total mismatch": "UNMATCHED", "TAX_OK": "UNMATCHED", "glare": "UNMATCHED", "x": "UNMATCHED", "?": "UNMATCHED", "z" * 100_000: "UNMATCHED",
}


def test_flags(spark, data):
    rows = [{"flags": [None, " ", "TAX_ERROR", k, k]} for k in FLAGS] + [{"flags": []}, {"flags": None}]
    catalogue = spark.read.parquet(f"{data}/flag_catalog.parquet").withColumn("raw", F.lit(1))
    got = {(r.result_id, r.pos): r.flag_code for r in vocabulary.map_flags(results(spark, rows), catalogue).collect()}
    assert got == {(i, p): v for i, v in enumerate(FLAGS.values()) for p in (3, 4)}
    empty = vocabulary.map_flags(results(spark, rows[:2]), catalogue.limit(0)).collect()
    assert {r.flag_code for r in empty} == {"UNMATCHED"} and len(empty) == 6
    assert vocabulary.map_flags(results(spark, rows).limit(0), catalogue).count() == 0


# --- names ------------------------------------------------------------------------------------------------------------


def test_repair_meets_every_word_within_its_tolerance(spark):
    rng = random.Random(5)
    known = ["".join(rng.choices("bdghjkmnprtw", k=k)) for k in (4, 5, 6, 8, 9, 10, 13, 20, 36)]
    typed = set(known)
    for v in known:
        for n in (1, 2, 3):
            for _ in range(6):
                t = v
                for _ in range(n):
                    i, c = rng.randrange(len(t)), rng.choice("bdghjkmnprtw")
                    t = rng.choice([t[:i] + t[i + 1 :], t[:i] + c + t[i:], t[:i] + c + t[i + 1 :]])
                typed.add(t)
    w = spark.createDataFrame([(t,) for t in sorted(typed)], "w string")
    k = spark.createDataFrame([(v, False) for v in known], "v string, titled boolean")
    fold = w.select("w", vocabulary._fold(F.col("w")).alias("fw")).crossJoin(k.select("v", vocabulary._fold(F.col("v")).alias("fv")))
    near = fold.select("w", "v", vocabulary._near(F.col("fw"), F.col("fv")).alias("s")).where("s is not null").collect()
    top = {r.w: max(x.s for x in near if x.w == r.w) for r in near}
    got = {(r.w, r.v) for r in vocabulary.repair(w, k).collect()}
    assert {(r.w, r.v) for r in near if r.s >= top[r.w] - 1e-9} == got and any(len(v) > 28 for _, v in got)


def test_names(spark):
    groups = [
        [["KOBEFAL FAPOJUL AUTO PARTS SDN. BHD.", "JALAN PITRAJOS 74/5"], ["*** DUPLICATE ***", "Kobefal Fapojul Autoparts Sdn Bhd"], ["FAPOJUL KOBEFAL AUTO PTS"], ["KOBEFALFAPOJUL AUTO PARTS"], ["KOBE FAL FAPOJUL"], ["K0BEFAL FAP0JUL A/PARTS"], ["KOBEFAL", "FAPOJUL AUTO PARTS SDN BHD"], ["KOBEFAL F AUTO PARTS"]],
        [["KOBEFAL ZIRUWEN BAKERY LTD", "JALAN PITRAJOS 74/5"], ["KOBEFAL ZIRUWEN BKRY", "REG (123456A)"], ["KOBE-Z BAKERY", "123456-A"]],
        [["TRUMODAX VEGILON"], ["TRUMODAX VEGILON"]],
        [["SOLOWER PANADERIA"]],
    ]
    flat = [(g, x) for g, v in enumerate(groups) for x in v]
    none = [None, [], [None], ["----"], ["OFFICIAL COPY", "LTD"], ["BAKERY"]]
    d = spark.createDataFrame([(i, x, "c") for i, x in enumerate([x for _, x in flat] + none)], "ocr_id long, company_lines array<string>, own string")
    got = {(r.ocr_id_a, r.ocr_id_b) for r in names.pairs(d).collect()}
    assert got == {(i, j) for i, (g, _) in enumerate(flat) for j, (h, _) in enumerate(flat) if i < j and g == h}
    assert names.pairs(d.limit(0)).count() == 0
    c = {r.ocr_id: (r.company, r.links) for r in names.companies(d, with_links=True).collect()}
    assert {(i, j) for i in c for j in c if i < j and c[i][0] == c[j][0]} == got and c[0][1] >= 1 and c[len(flat) - 1][1] == 0
    alone = {(r.ocr_id_a, r.ocr_id_b) for r in names.pairs(d, use_registration=False, use_places=False).collect()}
    assert (0, 1) in alone and alone < got


def test_records_of_a_place_do_not_depend_on_its_first(spark):
    """2 and 3 are alike, 4 and 5 are only when 4 is turned round; none is like the first record of the address."""
    lines = ["KOBEFAL FAPOJUL", "KOBEVIS TRALOMUN", "KOBEVAS TRULOMIX", "KOBEWIRE TRX DANUP", "DANUPOLI KOBEWIRETROX"]
    d = spark.createDataFrame([(i + 1, [x, "JALAN PITRAJOS 74/5"]) for i, x in enumerate(lines)], "ocr_id long, company_lines array<string>")
    links = {(r.a, r.b) for r in names._same_place(names.records(d).withColumnRenamed("ocr_id", "id")).collect()}
    assert links == {(2, 3), (4, 5)}
    assert [(r.ocr_id_a, r.ocr_id_b) for r in names.pairs(d.where("ocr_id < 4")).collect()] == [(2, 3)]


def test_names_with_numbers_and_short_words(spark):
    lines = [
        ["Dakál0N 8. Mini Market Sdn Bhd", "Lorong Nunuve 99-18"],
        ["MINI MARKET TRIN'S", "CO. NO (234740-U)", "JANUTRIS AVE 91 SUITE 34"],
        ["TRAD FERRETERIA", "432071-V"],
        ["JAMA8RIL 8"],
        ["KOBE SOP", "JALAN PITRAJOS 74/5"],
        ["JAALN PITRAJOS 74/5"],
        ["OFFICIAL COPY", "234740-U"],
        ["BAKERY"],
    ]
    d = spark.createDataFrame(list(enumerate(lines)), "ocr_id long, company_lines array<string>")
    got = {r.ocr_id: (r.own, r.initials, r.trade, r.reg, r.numbers) for r in names.records(d).collect()}
    assert got == {
        0: (["DAKALON"], ["B"], "MINIMARKET", None, "99-18"),
        1: (["TRIN"], [], "MINIMARKET", "234740U", "91-34"),
        2: ([], [], "TRADING", "432071V", ""),
        3: (["JAMABRIL"], ["B"], "", None, ""),
        4: (["KOBE"], [], "SHOP", None, "74-5"),
    }
    rows = [["TRINOVEX DAKULAM MINI MARKET", "(234740-U)"], lines[1], ["TRADOVEX DAKUMIR FERRETERIA", "432071-V"], lines[2], lines[6]]
    e = spark.createDataFrame(list(enumerate(rows)), "ocr_id long, company_lines array<string>")
    assert {(r.ocr_id_a, r.ocr_id_b) for r in names.pairs(e).collect()} == {(0, 1), (2, 3)}


def test_prefix_filter_loses_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("ABCDE", k=6)) for _ in range(40)]
    rows = [(i, rng.sample(words, 2)) for i in range(120)]
    grams = {i: {("^" + w + "$")[k : k + 5] for w in ws for k in range(4)} for i, ws in rows}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.12 * len(grams[a] | grams[b])}
    got = {(r.a, r.b) for r in names.candidate_pairs(spark.createDataFrame(rows, "id long, own array<string>")).collect()}
    assert want and want <= got


def test_names_meet_by_words_with_a_letter_left_out(spark):
    """Names whose words have an edit each share no gram, and meet; words that only share grams do not meet."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("BDGHJKLMNPRSTVWZ", k=n))

    def typo(w):
        i, c = rng.randrange(len(w) - 1), rng.choice("ABDEGHIJ")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    rows, groups = [], []
    for g in range(40):
        a, b = word(rng.randint(6, 9)), word(rng.randint(6, 9))
        forms = [[a, b], [b, a], [typo(a), typo(b)], [b, a[1] + a[0] + a[2:]], [a + b], [typo(a) + b], [a[:3], a[3:], b], [a[:-2], a[-2:] + b + "T"]]
        rows += [(len(rows) + i, f, [1.0] * len(f), False) for i, f in enumerate(forms)]
        groups += [g] * len(forms)
    schema = "id long, own array<string>, wt array<double>, ini boolean"
    got = {(r.a, r.b) for r in names.word_pairs(spark.createDataFrame(rows, schema)).collect()}
    clean = [i for i in range(0, len(rows), 8)]
    want = {(i, i + k) for i in clean for k in range(1, 7)}
    assert want <= got and {(groups[a], groups[b]) for a, b in got} == {(g, g) for g in range(40)}
    same_end = [(i, [f"{word(3)}EFAL", f"{word(3)}OJUL"], [1.0, 1.0], False) for i in range(300)]
    keys = spark.createDataFrame(same_end, schema).select("id", F.explode(F.array_distinct(F.transform(names._meeting_keys(F.col("own")), lambda k: k["key"]))).alias("key"))
    assert keys.groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] < 5000  # 89,700 by grams


def test_names_with_an_edit_in_each_word_are_linked(spark):
    lines = [["KOBEFAL FAPOJUL BAKERY"], ["KOBAFAL FAPIJUL BAKERY"], ["ZIRUWEN TRAMODIX BAKERY"], ["ZIRU WENTRAMODIX"], ["FAPOJUL TRUMODAX"], ["IZRUWEN T BAKERY"]]
    d = spark.createDataFrame(list(enumerate(lines)), "ocr_id long, company_lines array<string>")
    assert {(r.ocr_id_a, r.ocr_id_b) for r in names.pairs(d).collect()} == {(0, 1), (2, 3), (2, 5), (3, 5)}


# --- pairs ------------------------------------------------------------------------------------------------------------

PROMPT = "Receipt r1. You act as an auditor and look at the evidence. The parsed total is $5.10 and the tax line reads $0.30. Weigh the printed amounts above pen marks and stamps. Answer in English with one JSON object."
ANSWER = '{"label": "REAL", "confidence": 80, "reasons": ["The total of $5.10 agrees with the listed items.", "The stamp is on the paper"], "flags": []}'
WHOLE = ["The total of $5.10 agrees with the listed items.", "The stamp is on the paper"]
FAILED = {"label": "UNCERTAIN", "confidence": 0.0, "reasons": ["Response could not be used"]}


def answer(**kw):
    import json

    d = {"label": "REAL", "confidence": 80, "reasons": WHOLE, "flags": []} | kw
    return {"raw_response": json.dumps(d, ensure_ascii=False), "label": d["label"], "confidence": float(d["confidence"]), "reasons": d["reasons"]}


PAIRS = [
    (answer(), None), (FAILED | {"raw_response": None}, "empty"), (FAILED | {"raw_response": "  \n"}, "empty"), (FAILED | {"raw_response": "```json\n```"}, "empty"), (FAILED | {"raw_response": '{"label": "", "reasons": ["", ""]}'}, "empty"),
    (FAILED | {"raw_response": ANSWER[:70]}, "truncated"), (FAILED | {"raw_response": "My label is REAL. The total of $5.10 agrees wi"}, "truncated"), (answer(reasons=["The total of $7.00 ag", WHOLE[1]]), "truncated"), (answer(reasons=["The total of, which", WHOLE[1]]), "truncated"),
    (FAILED | {"raw_response": "I'm sorry, but I can't help with judging this document."}, "refusal"), (answer(label="UNCERTAIN", confidence=0, reasons=["This request goes against my guidelines, so no assessment will be given.", "I must decline to decide."]), "refusal"),
    (FAILED | {"raw_response": PROMPT}, "copy"), (FAILED | {"raw_response": "> " + PROMPT.upper()}, "copy"), (answer(label="UNCERTAIN", confidence=0, reasons=["Weigh the printed amounts above pen marks and stamps.", "The parsed total is $5.10 and the tax line reads $0.30."]), "copy"),
    (answer(reasons=["El total de 5,10 € coincide con los artículos.", "El ruido cerca del total es distinto al del papel."]), "language"), (answer(reasons=["付款行周围没有粘贴痕迹。", "价格栏的数字字体相同。"]), "language"),
    (answer() | {"raw_response": "The parsed total is $5.10 and the tax line reads $0.30.\n" + ANSWER}, None), (answer() | {"raw_response": str({"label": "REAL", "reasons": WHOLE})}, None), (answer(reasons=WHOLE * 3000), None),
]


def test_pairs(spark):
    rows = [r | {"prompt_id": 1} for r, _ in PAIRS]
    prompts = spark.createDataFrame([(1, PROMPT, "en", "t"), (1, PROMPT, "en", "t"), (2, None, None, "t")], "prompt_id long, prompt string, prompt_lang string, raw string")
    got = {r.result_id: r.defect for r in pairs.defects(results(spark, rows), prompts).collect()}
    assert got == {i: v for i, (_, v) in enumerate(PAIRS) if v}
    # Without a known prompt neither copy nor language can be told; an unknown language is read off the prompt.
    free = {r.result_id: r.defect for r in pairs.defects(results(spark, [r | {"prompt_id": 9} for r, _ in PAIRS]), prompts).collect()}
    assert {i for i, v in free.items()} == {i for i, (_, v) in enumerate(PAIRS) if v in ("empty", "truncated", "refusal")}
    guessed = pairs.defects(results(spark, rows), prompts.withColumn("prompt_lang", F.lit(None).cast("string")))
    assert {r.result_id: r.defect for r in guessed.collect()} == got
    assert pairs.defects(results(spark, rows).limit(0), prompts).count() == 0


def test_copies_among_other_words_and_stretched_refusals(spark):
    """Most runs of the answer are the prompt's, most of its distinct words are not; and a template with words put in between."""
    rng = random.Random(4)
    prompt = " ".join(rng.choices("total tax line paid cash date shop item".split(), k=70)) + "."
    other = " ".join(f"word{i}" for i in range(20)) + "."
    stretched = "I am, for all that this says and shows, not really or in any way able to help."
    rows = [FAILED | {"raw_response": f"{prompt} {other}", "prompt_id": 1}, FAILED | {"raw_response": stretched, "prompt_id": 1}, FAILED | {"raw_response": f"{other} {other} {other}", "prompt_id": 1}]
    prompts = spark.createDataFrame([(1, prompt, "en")], "prompt_id long, prompt string, prompt_lang string")
    assert {r.result_id: r.defect for r in pairs.defects(results(spark, rows), prompts).collect()} == {0: "copy", 1: "refusal"}


def test_lcs():
    rng = random.Random(5)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randrange(1, 90)) for _ in range(2))
        assert pairs.lcs(a, b) == slow(a, b)


# --- tokenizer --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return tokenizer.load_ranks(open(tokenizer.vocabulary_path(), "rb").read())


def test_merge_against_rescan(ranks):
    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(7)
    for _ in range(400):
        piece = "".join(rng.choices("aaabbcdefghé漢 ", k=rng.randrange(1, 60))).encode()
        assert tokenizer.merge(piece, ranks) == slow(piece)


def test_encode(spark, ranks):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "Hello  world's <|endoftext|>\n", "漢字かな交じり文。", "a" * 300_000, "🧾‍‮﻿", "x" + "́" * 50]
    d = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(1, "", None)], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in tokenizer.encode(d).collect())
    assert got == sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(1, [])])
    assert tokenizer.encode(d.limit(0)).count() == 0


def test_too_large_vocabulary(spark, tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"YQ== 0\n" * 10)
    monkeypatch.setattr(tokenizer, "MAX_VOCABULARY_BYTES", 5)
    with pytest.raises(ValueError, match="too large"):
        tokenizer.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "v"))


# --- sentences --------------------------------------------------------------------------------------------------------

UNITS = [
    ("flow", ["Mr. Smith paid 3.50 at 5 p.m. and left.", "He came back.", "Why?!"]), ("flow", ['The clerk said: "It jammed. I tried again."', "Then nothing."]), ("flow", ["See p. 3 of the U.S. report, e.g. the file scan_1.v2.png.", "Ref. No. 12 is missing."]),
    ("flow", ["Receipts list rice, oil, etc.", "The shop closed."]), ("flow", ["Hmm… the change is short.", "Why does it repeat?!"]), ("flow", ["1. The first entry.", "It goes on."]), ("flow", ["Siehe S. 5.", "Am 3. März fehlten z. B. 4 Bons.", "Gut!"]),
    ("flow", ["Véase la pág. 4.", "«Todo está pagado», respondió.", "¿Quién cobró?", "¡Nadie!"]), ("flow", ["El auditor preguntó: «¿Se pagó? Diga».", "Sí."]), ("flow", ["M. Durand a signé n° 4.", "Le total est faux !", "« Vide. Rien », dit-elle."]),
    ("flow", ["Βλ. σελ. 4 της αναφοράς.", "Γιατί λείπει;", "Ο κ. Ταβέλης ήρθε."]), ("flow", ["راجع ص. 4 من التقرير.", "هل دُفع؟", "قال: «نعم. لا»."]), ("flow", ["डॉ. करिन आए।", "मद क्र. 4 है।", "क्यों?"]), ("flow", ["ร้านนี้ปิดแล้ว", "เวลา 5.01 น. ที่สาขา", "ลด 29.5 บาท"]),
]
TIGHT = ["合計は45.5ユーロです。", "店員は「詰まりました。やり直し。」と答えた。", "なぜ？", "（控えは箱にあります。）", "审核员问：“是现金付款吗？”", "总额不对！", "看起来不合理……", "缺少地址。"]


def spans(spark, docs):
    d = spark.createDataFrame([(i, t, y, 1) for i, (y, t) in enumerate(docs)], "doc_id long, text string, layout string, s int")
    out = {}
    for r in sentences.sentences(d).collect():
        out.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    return {k: [docs[k][1][a:b] for a, b in sorted(v)] for k, v in out.items()}


def test_sentences(spark):
    docs = [(y, "  " + " ".join(u) + "\n") for y, u in UNITS] + [("flow", "".join(TIGHT))]
    got = spans(spark, docs)
    assert [got[i] for i in range(len(docs))] == [u for _, u in UNITS] + [TIGHT]


def test_very_long_documents(spark):
    """Every rule reads a text once: these take seconds, and took hours where a part was read again for every other."""
    n = 100_000
    docs = ["A long sentence. " * n + "“Yes.”", "He said “A. B.” then left. " * n, 'He said "It. Is." then left. ' * n, "Er sagte „Ja. Nein.“ und ging. " * n, "A." + " " * n + "b", "A." + "\n" * n + "b"]
    got = spans(spark, [("flow", t) for t in docs])
    assert [len(got[i]) for i in range(len(docs))] == [n + 1, n, n, n, 1, 2]


def test_layouts_and_edges(spark):
    docs = [("lines", " A B. C \r\n\r\n\tTOTAL 1.00\rX\n"), ("flow", "A heading\n \t\r\nOne line\nwraps here. Two."), ("flow", None), ("flow", ""), ("flow", " \n　 "), (None, "One. Two."), ("lines", None), ("flow", "No end"), ("flow", "El resto.El ticket fue 😀."), ("flow", "\ue000ab. Bc\ue0ff.")]
    assert spans(spark, docs) == {0: ["A B. C", "TOTAL 1.00", "X"], 1: ["A heading", "One line\nwraps here.", "Two."], 5: ["One.", "Two."], 7: ["No end"], 8: ["El resto.", "El ticket fue 😀."], 9: ["\ue000ab.", "Bc\ue0ff."]}
    assert spans(spark, [("flow", "A long sentence is here. " * 20_000)])[0] == ["A long sentence is here."] * 20_000
    assert sentences.sentences(spark.createDataFrame([], "doc_id long, text string, layout string")).count() == 0


def test_every_character_but_space_is_in_one_unit(spark, data):
    docs = [(r.layout, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for k, v in spans(spark, docs).items():
        assert "".join("".join(x.split()) for x in v) == "".join(docs[k][1].split())
