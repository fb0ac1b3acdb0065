import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tillscope.llm import contamination as C


def read(texts):
    flat, starts = C.words(pa.array(texts, pa.string()), {})
    return [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def coined(n, seed=9, size=7):
    rng = random.Random(seed)
    return ["".join(rng.choices("bdfhjkmnprtw", k=size)) for _ in range(n)]


@pytest.mark.parametrize("max_index_bytes", [256 << 20, 0])
def test_leaks(spark, max_index_bytes):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("bcdfgklmnprstvwz", k=2)) + "aeiou"[i % 5] + "".join(rng.choices("bdgklmnprst", k=2)) for i in range(400)]
    shared = "Read the notes on this receipt and choose one of the labels."
    passages = [" ".join(rng.choices(vocab, k=60 + i)) for i in range(8)]
    rows = [(i, f"{shared} {p}", "x") for i, p in enumerate(passages)] + [(90, None, "x"), (91, "", "x"), (92, "too short", "x"), (93, "whose stamp is it really", "x"), (0, f"{shared} {passages[0]}", "x")]
    items = spark.createDataFrame(rows, "item_id long, passage string, text string")
    fill = lambda n: " ".join(rng.choices(vocab, k=n))
    w = passages[3].split()
    scan = passages[4].replace("o", "0").replace("e", "c")
    docs = [
        (0, f"{fill(200)} {passages[0]} {fill(300)}", {0}), (1, f"{fill(50)} {' '.join(passages[1].split()[20:50]).upper().replace(' ', ', ')}. {fill(80)}", {1}), (2, f"{fill(30)} {' '.join(passages[2].split()[:12])} {fill(90)}", set()),
        (3, f"{fill(10)} {' '.join(w[:20])} {fill(25)} {' '.join(w[20:45])} {fill(9)}", {3}), (4, scan, {4}), (5, shared, set()), (6, fill(4000), set()), (7, None, set()), (8, "", set()), (9, f"{passages[5]} {passages[6]}", {5, 6}),
        (10, " ".join(x for x in passages[7].split() if rng.random() > 0.1), {7}), (11, fill(60_000) + " " + passages[0], {0}), (12, f"{fill(9)} Whose stamp is it, really? {fill(3)}", {93}), (13, "whose stamp is it not really too short", set()), (None, passages[5], {5}),
    ]
    d = spark.createDataFrame([(i, t, "c") for i, t, _ in docs] + [(4, scan, "c")], "doc_id long, text string, item_id string")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, k) for i, _, ks in docs for k in ks), key=key)
    got = C.leaks(d, items, max_index_bytes=max_index_bytes)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=key) == want
    assert C.leaks(d.limit(0), items, max_index_bytes=max_index_bytes).count() == 0 and C.leaks(d, items.limit(0), max_index_bytes=max_index_bytes).count() == 0


@pytest.mark.parametrize("max_index_bytes", [256 << 20, 0])
def test_no_item_is_dropped_for_being_equal_to_others(spark, max_index_bytes):
    """One passage under any number of ids is one passage; variants of each other are held where they stand nearly whole."""
    w = coined(40)
    text = " ".join(w)
    items = [(i, text) for i in range(9)] + [(20 + i, " ".join([*coined(20, 3), str(10**6 + i), *coined(20, 4)])) for i in range(6)]
    d = spark.createDataFrame([(1, f"x {text} y"), (2, f"z {items[12][1]} z"), (3, " ".join(coined(20, 3)))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in C.leaks(d, spark.createDataFrame(items, "item_id long, passage string"), max_index_bytes=max_index_bytes).collect()}
    assert got == {(1, i) for i in range(9)} | {(2, 20 + i) for i in range(6)}


def test_string_ids_and_word_forms(spark):
    d = spark.createDataFrame([("a", "Él pagó  «setenta» y tres; ０1 de marzo\u200b de dos mil")], "doc_id string, text string")
    i = spark.createDataFrame([("q", "el PAGO setenta y tres Ol de marz0 de dos mil")], "item_id string, passage string")
    assert [tuple(r) for r in C.leaks(d, i).collect()] == [("a", "q")]
    assert [len(x) for x in read(["漢字 かな abc", None, " . ", "a_b"])] == [5, 0, 0, 2]


def test_interruption_of_any_length():
    a, other = coined(60), coined(400, 1000)
    item, *texts = read([" ".join(x) for x in (a, a[:12] + other + a[48:], a[48:] + other + a[:12], a[:12] + other + a[54:])])
    index = C.Index([[1]], [item], set())
    assert [bool(list(index.match(t, np.array([0, len(t)])))) for t in texts] == [True, False, False]


def test_a_part_repeated_very_often_costs_no_pairs():
    a = coined(60)
    item, text = read([" ".join(a), " ".join((a[:9] + coined(3, 5)) * 20_000)])
    assert not list(C.Index([[1]], [item], set()).match(text, np.array([0, len(text)])))


def planted(n_items, n_docs, seed=2):
    """Items, documents with a part (a third and more) of an item each, a twentieth of its words altered, and the pairs."""
    rng = np.random.default_rng(seed)
    items = [rng.integers(1, 1 << 62, rng.integers(40, 160), np.uint64) | np.uint64(1) for _ in range(n_items)]
    docs, true = [], set()
    for k in range(n_docs):
        i = int(rng.integers(n_items))
        h = items[i]
        n = int(rng.integers(int(len(h) * 0.4) + 1, len(h) + 1))
        at = int(rng.integers(len(h) - n + 1))
        part = h[at : at + n].copy()
        part[rng.random(n) < 0.05] ^= np.uint64(2)
        filler = [rng.integers(1, 1 << 62, rng.integers(0, 400), np.uint64) for _ in range(2)]
        docs.append(np.r_[filler[0], part, filler[1]])
        true.add((k, i))
    return items, docs, true


def recall(n_items, n_docs):
    items, docs, _ = planted(n_items, n_docs)
    index = C.Index([[i] for i in range(n_items)], items, set())
    starts = np.r_[0, np.cumsum([len(d) for d in docs])]
    got = {(d, i) for d, ids in index.match(np.concatenate(docs), starts) for i in ids}
    # Brute force: every document is verified against every passage that shares a shingle with it.
    at = {}
    for i, p in enumerate(index.passages):
        for x in p.known.tolist():
            at.setdefault(x, set()).add(i)
    want = set()
    for d, h in enumerate(docs):
        s = C.shingles(h)
        for i, n in Counter(i for x in s.tolist() for i in at.get(x, ())).items():
            if n and C.held(index.passages[i], s, np.arange(len(s))):
                want.add((d, i))
    assert got <= want and len(want) >= 0.9 * n_docs
    return len(got) / len(want)


def test_search_recall_against_brute_force():
    assert recall(300, 400) >= 0.98


if __name__ == "__main__":
    for n in (10_000, 100_000):
        print(n, recall(n, 2_000))
