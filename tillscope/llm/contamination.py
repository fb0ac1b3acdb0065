"""Passages of held-out evaluation items inside a corpus.

Texts become words in a canonical form: no case, accents, punctuation or invisible characters, letters that scanners
confuse made equal, Han and Kana characters as words of their own; a word is a 64-bit hash. Three words make a shingle.

Items with equal words are one passage with many ids. Runs of five words that at least ``shared_share`` of the distinct
passages have (and four at least) are wording that many items share; the other words are an item's own.

Search: passages are partitioned by size (powers of two of their words). For every size the document is read in windows
of twice that size, one starting every half size. The MinHash values of a window (over the shingles that any passage
has; others cannot be common to both) are looked up in buckets, one for each of ``permutations`` hash functions and
value: a window meets only those passages that share a bucket, never all. From the share of equal values and both set
sizes follows an estimate of how much of the passage the window holds; windows above ``slack`` are candidates. A window
with fewer shingles than ``slack`` of the smallest passage of its size holds none, whatever it contains.

Verification, exact: the document must contain ``containment`` of the passage's own shingles. Common shingles are joined
to near-diagonal runs, and runs to the best chain in order; only short runs have bounded interruptions. The passage is
held if the chain covers at least ``share`` of its own words. Runs under six words do not count, so single short phrases
do not.

Short and shared passages: one of three to seven words is held where all of them stand in a row. A longer one of which
fewer than eight words are its own is held where nine tenths of all its words are. One or two words are no passage.

Null or blank texts give no row; repeated ids count once per pair; several passages under one id count each.

Scale: if the index (measured in words before anything is collected) has at most ``max_index_bytes``, it is broadcast
and the search is one narrow map over the documents, whatever the number of items. Beyond, passages are prepared as a
table and windows meet them in one join on (size, hash function, value), which adaptive execution splits where a value
is hot; the filter of known shingles is then a bit map of fixed size. Both ways find the same.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import cut

K = 3
RUN = 5
#: Passages of fewer words are matched whole.
LEAST = 8
#: Words of text that are worked on at once.
CHUNK_BYTES = 4_000_000
#: Bits of the map of known shingles, where the index is not broadcast.
MAP_BITS = 27
#: Characters that scanners confuse, by their representative.
CONFUSED = str.maketrans({"0": "o", "a": "o", "1": "l", "i": "l", "c": "e", "5": "s", "8": "b", "6": "b", "9": "g", "q": "g", "2": "z", "v": "u"})
_HAN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
_UNSEEN = r"[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}\x00-\x08\x0e-\x1f]|\p{M}"


def words(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and where each text begins (one entry more than texts)."""
    t = pc.utf8_lower(pc.replace_substring_regex(pc.utf8_normalize(pc.fill_null(texts, ""), form="NFKD"), _UNSEEN, ""))
    t = pc.replace_substring_regex(t, f"({_HAN})", r" \1 ")
    lists = pc.split_pattern_regex(t, r"[^\p{L}\p{N}]+")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    values = np.empty(len(coded.dictionary), np.uint64)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = int.from_bytes(hashlib.blake2b(w.translate(CONFUSED).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1 if w else 0
        values[i] = h
    flat = values[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
    starts = np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
    # Empty words stand only at the ends of a text; hashes of others are odd.
    return flat[flat != 0], np.r_[0, np.cumsum(flat != 0)][starts]


def chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of some megabytes, with the place of their first text."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def shingles(h: np.ndarray, k: int = K) -> np.ndarray:
    """One 64-bit value per run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[j : j + n] + np.uint64(j + 1))
        out ^= out >> np.uint64(29)
    return out


def own_words(h: np.ndarray, shared: set[int]) -> np.ndarray:
    """Which words are in no run that many passages share."""
    own = np.ones(len(h), bool)
    for p, x in enumerate(shingles(h, RUN).tolist()):
        if x in shared:
            own[p : p + RUN] = False
    return own


class Hashing:
    """The hash functions of the MinHash values."""

    def __init__(self, permutations: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, permutations, np.uint64)

    def __len__(self) -> int:
        return len(self.a)

    def values(self, s: np.ndarray) -> np.ndarray:
        """(hash function, shingle) -> 32 bits."""
        x = s[None, :] * self.a[:, None] + self.b[:, None]
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


class Passage:
    """One distinct passage: its words, which are its own, the own shingles, and the share that must be held."""

    def __init__(self, h: np.ndarray, shared: set[int], share: float):
        self.words, self.own, self.share = h, own_words(h, shared), share
        if self.own.sum() < LEAST:
            self.own, self.share = np.ones(len(h), bool), max(share, 0.9)
        s = shingles(h)
        touches = self.own[: len(s)].copy()
        for j in range(1, K):
            touches |= self.own[j : len(s) + j]
        self.all, self.sets = s, np.unique(s[touches])
        self.known = np.unique(s)
        self.searched = np.isin(self.known, self.sets, assume_unique=True)
        self.needed = self.share * int(self.own.sum())

    @property
    def size(self) -> int:
        """The class by number of words: a power of two not above it."""
        return 1 << max(3, (len(self.words) - 1).bit_length() - 1)


def windows(shingle: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: int, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first step, number of shingles, MinHash values by function) of the windows that begin at a step with a shingle.

    Shingles are in order of document and place. A window is two sizes: four steps.
    """
    step, parts = size // 2, 4
    block = pos // step
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])
    low = np.minimum.reduceat(hashed, start, axis=1)
    count = np.diff(np.r_[start, len(shingle)])
    d, b = doc[start], block[start]
    best, total = low.copy(), count.copy()
    for j in range(1, parts):
        near = np.zeros(len(d), bool)
        near[:-j] = (d[j:] == d[:-j]) & (b[j:] - b[:-j] < parts)
        i = np.flatnonzero(near)
        best[:, i] = np.minimum(best[:, i], low[:, i + j])
        total[i] += count[i + j]
    return d, b, total, best


def meets(equal: np.ndarray, count: np.ndarray, size: np.ndarray, permutations: int, slack: float) -> np.ndarray:
    """Whether the estimate of what a window holds of a passage's shingles reaches ``slack``."""
    jaccard = equal / permutations
    return jaccard / (1 + jaccard) * (size + count) >= slack * size


class Index:
    """Passages with their buckets, and what verification needs."""

    def __init__(self, ids: list[list], items: list[np.ndarray], shared: set[int], share: float = 1 / 3, slack: float = 0.14, containment: float = 0.2, permutations: int = 64):
        self.hashing, self.slack, self.containment = Hashing(permutations), slack, containment
        whole = [i for i, h in enumerate(items) if K <= len(h) < LEAST]
        #: Number of words -> sorted hashes of whole passages, and their ids.
        self.short = {}
        for n in {len(items[i]) for i in whole}:
            at = sorted((int(shingles(items[i], n)[0]), i) for i in whole if len(items[i]) == n)
            self.short[n] = np.array([x for x, _ in at], np.uint64), [ids[i] for _, i in at]
        use = [i for i, h in enumerate(items) if len(h) >= LEAST]
        self.ids, self.passages = [ids[i] for i in use], [Passage(items[i], shared, share) for i in use]
        self.vocabulary = np.unique(np.concatenate([p.all for p in self.passages])) if use else np.empty(0, np.uint64)
        self.searched = np.zeros(len(self.vocabulary), bool)
        for p in self.passages:
            self.searched[np.searchsorted(self.vocabulary, p.sets)] = True
        self.map = known_map(self.vocabulary)
        self.sizes = np.array([len(p.sets) for p in self.passages])
        self.classes = []
        by = np.array([p.size for p in self.passages], np.int64)
        for size in np.unique(by).tolist():
            at = np.flatnonzero(by == size)
            values = np.stack([self.hashing.values(self.passages[i].sets).min(axis=1) for i in at])
            keys = (np.arange(permutations, dtype=np.uint64) << np.uint64(32))[None, :] | values.astype(np.uint64)
            order = np.argsort(keys, axis=None, kind="stable")
            self.classes.append((size, slack * self.sizes[at].min(), keys.ravel()[order], np.repeat(at, permutations)[order]))

    def code(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in s, numbers in the vocabulary) of the shingles that a passage has."""
        maybe = np.flatnonzero(looked_up(self.map, s)) if len(self.vocabulary) else np.empty(0, np.int64)
        code = np.searchsorted(self.vocabulary, s[maybe])
        code[code == len(self.vocabulary)] = 0
        keep = self.vocabulary[code] == s[maybe] if len(maybe) else np.empty(0, bool)
        return maybe[keep], code[keep]

    def candidates(self, code: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> set[tuple[int, int]]:
        """(document, passage) that share buckets enough, from the searched shingles in order."""
        out: set[tuple[int, int]] = set()
        if not len(code):
            return out
        hashed = self.hashing.values(self.vocabulary[code])
        n = np.uint64(32)
        for size, least, keys, items in self.classes:
            d, _, total, best = windows(code, doc, pos, size, hashed)
            full = np.flatnonzero(total >= least)
            for lo in range(0, len(full), 1024):
                w = full[lo : lo + 1024]
                asked = ((np.arange(len(best), dtype=np.uint64) << n)[:, None] | best[:, w].astype(np.uint64)).ravel()
                a, b = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
                many = b - a
                if not many.sum():
                    continue
                which = np.repeat(np.tile(np.arange(len(w)), len(best)), many)
                place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
                pair, equal = np.unique(which * np.int64(len(self.passages)) + items[place], return_counts=True)
                at, item = np.divmod(pair, len(self.passages))
                ok = meets(equal, total[w][at], self.sizes[item], len(best), self.slack)
                out.update(zip(d[w][at[ok]].tolist(), item[ok].tolist(), strict=True))
        return out

    def match(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list]]:
        """(text, ids of the passage that it holds) of texts given by ``words``."""
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for n, (hashes, ids) in self.short.items():
            s = shingles(flat, n)
            s = np.where(doc[: len(s)] == doc[n - 1 :], s, 0) if len(s) else s
            at = np.searchsorted(hashes, s)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == s):
                yield int(doc[i]), ids[at[i]]
        s = shingles(flat)
        place, code = self.code(s)
        inside = doc[place] == doc[place + K - 1]
        place, code = place[inside], code[inside]
        own = self.searched[code]
        pairs = self.candidates(code[own], doc[place[own]], (place - starts[doc[place]])[own])
        begin = np.searchsorted(doc[place], np.arange(len(starts)))
        for d, i in pairs:
            part = slice(begin[d], begin[d + 1])
            if held(self.passages[i], s[place[part]], place[part] - starts[d], self.containment):
                yield d, self.ids[i]


def known_map(vocabulary: np.ndarray) -> np.ndarray:
    """Bits of the shingles' lower bits, some 16 for every shingle."""
    bits = min(MAP_BITS, max(10, int(len(vocabulary)).bit_length() + 4))
    out = np.zeros(1 << (bits - 3), np.uint8)
    x = vocabulary & np.uint64((1 << bits) - 1)
    np.bitwise_or.at(out, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
    return out


def looked_up(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    x = s & np.uint64(len(bits) * 8 - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1


def held(p: Passage, s: np.ndarray, pos: np.ndarray, containment: float = 0.2) -> bool:
    """Whether a text with the shingles s at pos (others left out) holds the passage."""
    at = np.searchsorted(p.known, s)
    at[at == len(p.known)] = 0
    mine = p.known[at] == s
    has = np.zeros(len(p.known), bool)
    has[at[mine]] = True
    if (has & p.searched).sum() < containment * len(p.sets):
        return False
    s, pos = s[mine], pos[mine]
    return chain(runs(p.all, s, pos), p.own, p.needed) >= p.needed


def runs(a: np.ndarray, b: np.ndarray, pos: np.ndarray, gap: int = 4) -> list[tuple[int, int, int, int, int]]:
    """Near-diagonal runs of common shingles: (from, to) in a, (from, to) in b (given with places), number of shingles."""
    at: dict[int, list[int]] = defaultdict(list)
    for q, x in zip(pos.tolist(), b.tolist(), strict=True):
        at[x].append(q)
    # Runs by diagonal, as many diagonals in one place as a run may shift.
    open_: dict[int, list[list[int]]] = defaultdict(list)
    done: list[list[int]] = []
    for p, x in enumerate(a.tolist()):
        for q in at.get(x, ()):
            k, fit = (q - p) // (gap + 1), None
            for j in (k - 1, k, k + 1):
                if j in open_:
                    live = []
                    for r in open_[j]:
                        if p - r[1] > gap + K:
                            continue
                        live.append(r)
                        if 0 < p - r[1] and 0 < q - r[3] <= gap + K and abs((p - r[1]) - (q - r[3])) <= gap and (fit is None or r[4] > fit[1][4]):
                            fit = j, r
                    open_[j] = live
            if fit:
                r = fit[1]
                r[1], r[3], r[4] = p, q, r[4] + 1
                if fit[0] != k:
                    open_[fit[0]] = [o for o in open_[fit[0]] if o is not r]
                    open_[k].append(r)
            else:
                r = [p, p, q, q, 1]
                open_[k].append(r)
                done.append(r)
    return [(r[0], r[1] + K, r[2], r[3] + K, r[4]) for r in done]


def chain(found: list[tuple[int, int, int, int, int]], own: np.ndarray, enough: float, least: int = 6, density: float = 0.3, interruption: int = 80, skipped: int = 60, sure: int = 8) -> int:
    """Own words in the best chain of runs that is in order in both texts, or in the first that has ``enough``.

    Runs of ``sure`` shingles are no chance, so whatever lies between two of them; a shorter run must be near. Runs are
    taken in the order of their beginnings in the text; of those that ended before, the near ones are kept one by one,
    and of the sure ones the best for each stretch of the passage. So a text that repeats a part does not pay in pairs.
    """
    upto = np.r_[0, np.cumsum(own)].tolist()
    wide = sorted((r for r in found if r[1] - r[0] >= least and r[4] >= density * (r[1] - r[0])), key=lambda r: (r[2], r[0]))
    waiting: list[tuple[int, int, int, int, int]] = []
    near: deque[tuple[int, int, int, int, int]] = deque()
    far: dict[tuple[int, int], int] = {}
    top = 0
    for p0, p1, q0, q1, m in wide:
        while waiting and waiting[0][0] <= q0 + 2 * K:
            t1, s0, s1, n, score = heapq.heappop(waiting)
            near.append((t1, s0, s1, n, score))
            if n >= sure and score > far.get((s0, s1), 0):
                far[s0, s1] = score
        while near and q0 - near[0][0] > interruption:
            near.popleft()
        best = 0
        for _, s0, s1, _, score in near:
            if s0 < p0 and s1 < p1 and p0 - s1 <= skipped:
                best = max(best, score - max(0, upto[s1] - upto[p0]))
        if m >= sure:
            for (s0, s1), score in far.items():
                if s0 < p0 and s1 < p1:
                    best = max(best, score - max(0, upto[s1] - upto[p0]))
        score = best + upto[p1] - upto[p0]
        top = max(top, score)
        if top >= enough:
            break
        heapq.heappush(waiting, (q1, p0, p1, m, score))
    return top


def leaks(
    documents: DataFrame,
    items: DataFrame,
    share: float = 1 / 3,
    slack: float = 0.14,
    containment: float = 0.2,
    shared_share: float = 0.025,
    max_index_bytes: int = 256 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
) -> DataFrame:
    """(id_col, item_col): one row per document and item that it holds."""
    spark = documents.sparkSession
    given = items.select(F.col(item_col).alias("item"), F.col(passage_col).alias("passage")).where("passage is not null")
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    n, size = given.agg(F.count("*"), F.sum(F.regexp_count("passage", F.lit(r"[぀-ヿ㐀-鿿]|[\p{L}\p{N}]+")))).first()
    # A word has its hash, a mark, a shingle in the passage and in the vocabulary; a passage 64 buckets.
    if 30 * (size or 0) + 900 * n > max_index_bytes:
        return _joined(source, given, share, slack, containment, shared_share, id_col, item_col)
    rows = given.collect()
    flat, starts = words(pa.array([r[1] for r in rows], pa.string()), {})
    same: dict[bytes, list] = {}
    for i, r in enumerate(rows):
        ids = same.setdefault(flat[starts[i] : starts[i + 1]].tobytes(), [])
        if r[0] not in ids:
            ids.append(r[0])
    texts = [np.frombuffer(x, np.uint64) for x in same]
    seen: Counter = Counter()
    for h in texts:
        seen.update(set(shingles(h, RUN).tolist()))
    many = max(4, shared_share * len(texts))
    index = Index(list(same.values()), texts, {x for x, c in seen.items() if c >= many}, share, slack, containment)
    sent = spark.sparkContext.broadcast(index)
    kind = _arrow_type(items.schema[item_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            take, found = [], []
            for lo, part in chunks(batch.column(1)):
                for d, ids in sent.value.match(*words(part, known)):
                    take += [lo + d] * len(ids)
                    found += ids
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(found, kind)], ["id", "item"])

    schema = f"id {documents.schema[id_col].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}"
    return source.mapInArrow(run, schema).dropDuplicates().select(F.col("id").alias(id_col), F.col("item").alias(item_col))


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def _joined(source: DataFrame, given: DataFrame, share: float, slack: float, containment: float, shared_share: float, id_col: str, item_col: str) -> DataFrame:
    """The same search where the index is too large for one machine: passages and windows meet in a join on buckets."""
    spark = source.sparkSession
    longs = lambda x: pa.array([v.view(np.int64) for v in x], pa.list_(pa.int64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            flat, starts = words(b.column(1), known)
            h = [flat[lo:hi] for lo, hi in zip(starts[:-1], starts[1:], strict=True)]
            r = [np.unique(shingles(x, RUN)) for x in h]
            yield pa.RecordBatch.from_arrays([b.column(0), longs(h), longs(r)], ["item", "words", "runs"])

    kind = given.schema["item"].dataType.simpleString()
    each = cut(given.mapInArrow(read, f"item {kind}, words array<bigint>, runs array<bigint>").where(F.size("words") >= K))
    each = each.withColumn("key", F.xxhash64("words"))
    distinct = cut(each.dropDuplicates(["key"]).select("key", "words", "runs"))
    many = max(4, shared_share * distinct.count())
    shared = distinct.select("key", F.explode("runs").alias("run"))
    shared = shared.join(shared.groupBy("run").count().where(F.col("count") >= many), "run").groupBy("key").agg(F.collect_set("run").alias("shared"))
    prepared = cut(distinct.join(shared, "key", "left").select("key", "words", F.coalesce("shared", F.array().cast("array<bigint>")).alias("shared")))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing()
        for b in batches:
            keys, sizes, counts, values, sets = [], [], [], [], []
            for key, w, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.array(w, np.int64).view(np.uint64)
                p = Passage(h, set(np.array(s, np.int64).view(np.uint64).tolist()), share) if len(h) >= LEAST else None
                keys.append(key)
                # A short passage is its own bucket, of negative size.
                sizes.append(p.size if p else -len(h))
                sets.append(p.sets if p else np.empty(0, np.uint64))
                counts.append(len(p.sets) if p else 0)
                values.append(hashing.values(p.sets).min(axis=1).astype(np.int64) if p else shingles(h, len(h)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int32()), pa.array(values, pa.list_(pa.int64())), longs(sets)], ["key", "size", "n", "low", "sets"])

    table = cut(prepared.mapInArrow(bucket, "key bigint, size int, n int, low array<bigint>, sets array<bigint>"))
    classes = [(r["size"], slack * r["least"]) for r in table.groupBy("size").agg(F.min("n").alias("least")).collect()]
    position = F.col("x").bitwiseAND((1 << MAP_BITS) - 1) + 1
    marks = table.select(F.explode("sets").alias("x")).groupBy(F.bitmap_bucket_number(position).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("m"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in marks.toLocalIterator():
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        bits[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    sent = spark.sparkContext.broadcast(bits)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, known = Hashing(), {}
        names = ["text_key", "size", "f", "low", "count", "window"]
        for batch in batches:
            text_key = np.asarray(batch.column(0))
            for lo, part in chunks(batch.column(1)):
                flat, starts = words(part, known)
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                for size, _ in (c for c in classes if c[0] < 0):
                    s = shingles(flat, -size)
                    at = np.flatnonzero(doc[: len(s)] == doc[-size - 1 :]) if len(s) else np.empty(0, np.int64)
                    k = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(text_key[lo + doc[at]]), pa.array(np.full(k, size, np.int32)), pa.array(np.zeros(k, np.int32)), pa.array(s[at].view(np.int64)), pa.array(np.zeros(k, np.int32)), pa.array(at)], names)
                s = shingles(flat)
                place = np.flatnonzero(looked_up(sent.value, s))
                place = place[doc[place] == doc[place + K - 1]]
                if not len(place):
                    continue
                hashed = hashing.values(s[place])
                for size, least in (c for c in classes if c[0] > 0):
                    d, b, total, best = windows(s[place], doc[place], place - starts[doc[place]], size, hashed)
                    full = np.flatnonzero(total >= least)
                    for f in range(len(best)):
                        k = len(full)
                        yield pa.RecordBatch.from_arrays([pa.array(text_key[lo + d[full]]), pa.array(np.full(k, size, np.int32)), pa.array(np.full(k, f, np.int32)), pa.array(best[f, full].astype(np.int64)), pa.array(total[full].astype(np.int32)), pa.array(b[full].astype(np.int64))], names)

    # Equal texts are searched once.
    texts = source.select(F.xxhash64("text").alias("text_key"), "text")
    seen = texts.dropDuplicates(["text_key"]).mapInArrow(cut_up, "text_key bigint, size int, f int, low bigint, count int, window bigint")
    asked = table.select("key", "size", "n", F.posexplode("low").alias("f", "low"))
    hit = seen.join(asked, ["size", "f", "low"]).groupBy("text_key", "key", "size", "window").agg(F.count("*").alias("equal"), F.first("n").alias("n"), F.first("count").alias("count"))
    jaccard = F.col("equal") / len(Hashing())
    enough = (F.col("size") < 0) | (jaccard / (1 + jaccard) * (F.col("n") + F.col("count")) >= slack * F.col("n"))
    pairs = cut(hit.where(enough).select("text_key", "key", "size").distinct())
    full = pairs.join(prepared, "key").join(texts.dropDuplicates(["text_key"]), "text_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            keep = []
            for i, (w, s, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("words", "shared", "text")), strict=True)):
                h = np.array(w, np.int64).view(np.uint64)
                flat, _ = words(pa.array([text], pa.string()), known)
                if len(h) < LEAST:
                    keep.append(bool(np.isin(shingles(h, len(h)), shingles(flat, len(h))).all()))
                else:
                    x = shingles(flat)
                    keep.append(held(Passage(h, set(np.array(s, np.int64).view(np.uint64).tolist()), share), x, np.arange(len(x)), containment))
            yield b.filter(pa.array(keep, pa.bool_())).select(["text_key", "key"])

    good = full.select("text_key", "key", "words", "shared", "text").mapInArrow(verify, "text_key bigint, key bigint")
    out = good.join(source.select("id", F.xxhash64("text").alias("text_key")), "text_key").join(each.select("item", "key"), "key")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col)).dropDuplicates()
