"""Encoding texts with a public byte-level BPE: contiguous rank arrays over words, one pass, no shuffle."""

from __future__ import annotations

import base64
import heapq
import os
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

# The word pattern that the public vocabulary byte_bpe_50k is defined with.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = 1 << 30
LONG_WORD = 96  # bytes; from here on the minimum is kept in a heap instead of being searched
CACHE_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> id of a .tiktoken file (50 thousand entries, under 1 MB)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank is merged, the leftmost among equals, until none has a rank.

    Two parallel arrays hold the part boundaries and the rank of each part joined with its right neighbour. A merge
    deletes one boundary and refreshes the ranks of its two neighbours only.
    """
    n = len(word)
    if n >= LONG_WORD:
        return _merge_long(word, ranks)
    get = ranks.get
    start = list(range(n + 1))
    rank = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)] + [NO_RANK]
    while True:
        low = min(rank)
        if low == NO_RANK:
            break
        i = rank.index(low)
        del start[i + 1], rank[i + 1]
        last = len(start) - 1
        rank[i] = get(word[start[i] : start[i + 2]], NO_RANK) if i + 2 <= last else NO_RANK
        if i:
            rank[i - 1] = get(word[start[i - 1] : start[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(start, start[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge_word, with linked parts and a heap of (rank, position): n log n for words of any length."""
    n, get = len(word), ranks.get
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NO_RANK)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j] = 0
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := get(word[i : end[nxt[i]]], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (h := prv[i]) >= 0 and (r := get(word[h:e], NO_RANK)) != NO_RANK:
            heapq.heappush(heap, (r, h, e))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Text -> ids, remembering the ids of words seen (at most CACHE_WORDS of them, then it starts anew)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.split, self.known = ranks, regex.compile(WORDS).findall, {}

    def word(self, w: str) -> tuple[int, ...]:
        b = w.encode("utf-8", "surrogatepass")
        r = self.ranks.get(b)
        ids = (r,) if r is not None else tuple(merge_word(b, self.ranks))
        if len(b) <= LONG_WORD:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[w] = ids
        return ids

    def encode(self, text: str | None, into: array) -> None:
        if text:
            get, extend = self.known.get, into.extend
            for w in self.split(text):
                extend(get(w) or self.word(w))


def _encoder(vocabulary) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    made = _encoder.__dict__.setdefault("made", {})
    if vocabulary.id not in made:
        made.clear()
        made[vocabulary.id] = Encoder(vocabulary.value)
    return made[vocabulary.id]


class _Shared:
    """The vocabulary as a broadcast of known size (under 1 MB), with an id for the worker's cache."""

    def __init__(self, spark, path: str):
        self.id, self._b = path, spark.sparkContext.broadcast(read_ranks(path))

    @property
    def value(self):
        return self._b.value


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", ids: bool = True) -> DataFrame:
    """key and ids (ARRAY<INT>) of every row, or with ids=False key and n_tokens (BIGINT).

    No special tokens: their strings are ordinary text. A NULL and an empty text both have the empty list (0 tokens);
    a blank text has the ids of its blanks. Rows stay as they are, repeated ones too. One narrow stage: whole texts
    stream through Arrow batches, nothing is shuffled. Other columns of df are not read.
    """
    shared = _Shared(df.sparkSession, vocabulary)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType

    def run(batches):
        enc = _encoder(shared)
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                enc.encode(t, flat)
                ends.append(len(flat))
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
            if ids:
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)], names=[key, "ids"])
            else:
                n = pa.array([y - x for x, y in zip(ends, ends[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), n], names=[key, "n_tokens"])

    out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())) if ids else T.StructField("n_tokens", T.LongType())])
    return src.mapInArrow(run, out)
