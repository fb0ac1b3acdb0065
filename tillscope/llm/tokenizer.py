"""Encoding a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern, and the bytes of each piece are merged pair by pair, lowest rank
first and leftmost among equals. A segment tree over the byte positions holds in each node the leftmost minimum of the
pair ranks below it, so each merge costs three logarithmic point updates (the merged pair, the token that vanished and
the left neighbour), and a piece of n bytes costs O(n log n), however long it is.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. The text is taken as
it is. Repeated ids and extra columns do not matter: each row is encoded by itself.

Scale: a narrow map without a shuffle. The vocabulary file, of a checked size, is broadcast. Each worker keeps the ids
of short pieces it met, in a table of bounded size that changes speed only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts text into pieces for the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY_BYTES = 64 << 20
CACHE_PIECES, CACHE_BYTES = 200_000, 48


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabularies are; any other path may be given instead."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, which is the id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get, none = ranks.get, 1 << 62
    size = 1 << (n - 1).bit_length()
    # A leaf is rank * size + position, so that the minimum is the lowest rank and of these the leftmost.
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours

    def put(k: int, value: int) -> None:
        k += size
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while (top := tree[1]) < none:
        i = top & (size - 1)
        j = after[i]
        end = after[j]
        after[i] = end
        put(j, none)
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            put(i, none if r is None else r * size + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = get(piece[h:end])
            put(h, none if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for s in self.find(text or ""):
            ids = known.get(s)
            if ids is None:
                b = s.encode("utf-8")
                ids = merge(b, self.ranks)
                if len(b) <= CACHE_BYTES:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[s] = ids
            out += ids
        return out


def encode(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids array<int>): one row for every row of ``documents``."""
    data = Path(path or vocabulary_path()).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {len(data)} bytes is too large to broadcast")
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(sent.value), pattern)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
