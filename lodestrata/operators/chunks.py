"""Content-defined chunking and the chunk store: cutting, range reads, reconstruction, collection, verification."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.hypervectors import splitmix64

MIN_CHUNK, MAX_CHUNK = 8 * 1024, 128 * 1024
BOUNDARY_MASK = np.uint64(0xFFFF_0000_0000_0000)


@lru_cache(1)
def gear_table() -> np.ndarray:
    """256 words of the rolling hash, generated (SplitMix64 from seed 1) rather than listed."""
    out, s = np.empty(256, dtype=np.uint64), 1
    for i in range(256):
        s, out[i] = splitmix64(s)
    return out


def boundaries(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each chunk: cut where the top 16 bits of the gear hash are 0, from 8 KiB on, at most 128 KiB.

    The hash h = 2h + gear[byte] depends on the last 64 bytes only, so all positions of a window are computed at once as
    six doubling steps of shifted sums instead of byte by byte. It starts at 0 at the 8 KiB floor of each chunk.
    """
    out, start, n, gear = [], 0, len(data), gear_table()
    raw = np.frombuffer(data, dtype=np.uint8)
    while start < n:
        if n - start <= MIN_CHUNK:
            out.append((start, n - start))
            break
        lo, hi = start + MIN_CHUNK, min(start + MAX_CHUNK, n)
        h = gear[raw[lo:hi]].copy()
        for step in (1, 2, 4, 8, 16, 32):
            if len(h) > step:
                h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        cut = np.flatnonzero((h & BOUNDARY_MASK) == 0)
        end = lo + int(cut[0]) + 1 if len(cut) else hi
        out.append((start, end - start))
        start = end
    return out


def chunk(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(key, seq, chunk_hash, byte_offset, byte_len, chunk_bytes) of every row with content; empty content has no chunk.

    SHA-256 takes the place of a hash that isn't available here. One narrow stage over whole contents.
    """
    src = files.filter(F.col(content).isNotNull()).select(F.col(key).alias("k"), F.col(content).alias("c"))

    def run(batches):
        for b in batches:
            ks, seq, hs, off, ln, by = [], [], [], [], [], []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (o, n) in enumerate(boundaries(c)):
                    part = c[o : o + n]
                    ks.append(k), seq.append(i), hs.append(hashlib.sha256(part).digest()), off.append(o), ln.append(n), by.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.column(0).type), pa.array(seq, pa.int64()), pa.array(hs, pa.binary()), pa.array(off, pa.int64()), pa.array(ln, pa.int64()), pa.array(by, pa.binary())], names=["k", "seq", "chunk_hash", "byte_offset", "byte_len", "chunk_bytes"])

    kind = files.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, seq long, chunk_hash binary, byte_offset long, byte_len long, chunk_bytes binary").withColumnRenamed("k", key)


def store(chunks: DataFrame) -> DataFrame:
    """The blob store: each chunk once by its hash."""
    return chunks.select("chunk_hash", "chunk_bytes", F.octet_length("chunk_bytes").alias("chunk_len")).dropDuplicates(["chunk_hash"])


def dedup_ratio(manifest: DataFrame) -> DataFrame:
    """Bytes referenced, bytes stored once, and their ratio."""
    m = manifest.select("node_id", "seq", "chunk_hash", "byte_len").distinct()
    logical = m.agg(F.sum("byte_len").alias("logical_bytes"), F.count(F.lit(1)).alias("n_refs"))
    physical = m.groupBy("chunk_hash").agg(F.max("byte_len").alias("n")).agg(F.sum("n").alias("stored_bytes"), F.count(F.lit(1)).alias("n_chunks"))
    return logical.crossJoin(physical).withColumn("ratio", F.col("logical_bytes") / F.col("stored_bytes"))  # single rows


def read_ranges(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pieces (node_id, lo, hi, seq, chunk_hash, from_byte, n_bytes) that make up the byte ranges [lo, hi) of nodes.

    An interval-overlap join by buckets of MAX_CHUNK: chunks are at most that long, so one that begins in bucket b reaches
    no further than b + 1, and a range looks into the buckets from one before its start to its end.
    """
    m = manifest.select("node_id", "seq", "chunk_hash", "byte_offset", "byte_len").distinct().withColumn("bucket", F.floor(F.col("byte_offset") / MAX_CHUNK))
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / MAX_CHUNK) - 1, F.floor(F.greatest(F.col("hi") - 1, F.col("lo")) / MAX_CHUNK))))
    hit = r.join(m, ["node_id", "bucket"]).filter((F.col("byte_offset") < F.col("hi")) & (F.col("byte_offset") + F.col("byte_len") > F.col("lo")))
    first = F.greatest(F.col("lo") - F.col("byte_offset"), F.lit(0))
    last = F.least(F.col("hi") - F.col("byte_offset"), F.col("byte_len"))
    return hit.select("node_id", "lo", "hi", "seq", "chunk_hash", first.alias("from_byte"), (last - first).alias("n_bytes"))


def reconstruct(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, content_len, complete, content_sha): the chunks of each node joined in order.

    `complete` says that every chunk exists and that they tile the content without gap. The bytes of one node are one
    value by their nature.
    """
    m = manifest.select("node_id", "seq", "chunk_hash", "byte_offset", "byte_len").distinct()
    c = chunks.filter(F.col("chunk_hash").isNotNull()).groupBy("chunk_hash").agg(F.max("chunk_bytes").alias("chunk_bytes"))
    j = m.join(c, "chunk_hash", "left")
    parts = F.array_sort(F.collect_list(F.struct("seq", "byte_offset", "byte_len", F.hex("chunk_bytes").alias("x"))))
    g = j.groupBy("node_id").agg(parts.alias("p"))
    whole = F.expr("forall(p, x -> x.x IS NOT NULL AND length(x.x) = 2 * x.byte_len) AND forall(sequence(0, size(p) - 1), i -> p[i].seq = i AND p[i].byte_offset = aggregate(slice(p, 1, i), 0L, (s, y) -> s + y.byte_len))")
    return g.select("node_id", F.expr("aggregate(p, 0L, (s, y) -> s + y.byte_len)").alias("content_len"), whole.alias("complete"), F.sha2(F.unhex(F.array_join(F.transform("p", lambda y: y["x"]), "")), 256).alias("content_sha"))


def unreachable(chunks: DataFrame, *manifests: DataFrame) -> DataFrame:
    """Chunks that no manifest names: the collector's candidates."""
    left = chunks.select("chunk_hash", "chunk_len").distinct()
    for m in manifests:
        left = left.join(m.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    return left


def dead_manifests(manifest: DataFrame, nodes: DataFrame) -> DataFrame:
    """Manifest entries of nodes that are gone."""
    return manifest.select("node_id", "seq").distinct().join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_anti")


def collect_garbage(chunks: DataFrame, *manifests: DataFrame) -> DataFrame:
    """Balanced accounting of a dry run: what is there before, what goes, what stays (before = gone + kept)."""
    one = chunks.select("chunk_hash", "chunk_len").distinct()
    gone = unreachable(chunks, *manifests).withColumn("gone", F.lit(1)).select("chunk_hash", "gone")
    j = one.join(gone, "chunk_hash", "left").withColumn("g", F.coalesce("gone", F.lit(0)))
    return j.agg(F.count(F.lit(1)).alias("n_before"), F.sum("g").alias("n_gone"), F.sum(1 - F.col("g")).alias("n_kept"), F.sum("chunk_len").alias("bytes_before"), F.coalesce(F.sum(F.col("chunk_len") * F.col("g")), F.lit(0)).alias("bytes_gone"))


def merkle_roots(leaves: DataFrame, group: str, pos: str, digest: str, fan: int = 1024) -> DataFrame:
    """(group, n_leaves, root): pairwise tree over a group's leaf digests in order; an odd one moves up as it is.

    Aligned runs of `fan` leaves (a power of two) are subtrees of that tree, so each is folded where its at most `fan`
    digests are, and the next level has 1/fan of the rows; the number of levels grows with the log of the largest group.
    Nodes are SHA-256 over 0x01, left, right.
    """

    @F.pandas_udf("binary")
    def fold(xs: pd.Series) -> pd.Series:
        def one(level):
            level = [bytes(x) for x in level]
            while len(level) > 1:
                nxt = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
                level = nxt + level[len(nxt) * 2 :]
            return level[0]

        return xs.map(one)

    cur = leaves.select(group, F.col(pos).cast("long").alias("_p"), F.col(digest).alias("_d"))
    sizes = cur.groupBy(group).agg(F.count(F.lit(1)).alias("n_leaves"))
    most = sizes.agg(F.max("n_leaves")).first()[0] or 0
    while most > 0:
        packed = cur.groupBy(group, F.floor(F.col("_p") / fan).alias("_q")).agg(F.array_sort(F.collect_list(F.struct("_p", "_d"))).alias("_a"))
        cur = packed.select(group, F.col("_q").alias("_p"), fold(F.transform("_a", lambda x: x["_d"])).alias("_d"))
        if most <= fan:
            break
        most = -(-most // fan)
    return cur.select(group, F.col("_d").alias("root")).join(sizes, group)


def verify_blobs(chunks: DataFrame, hash_col: str = "chunk_hash", bytes_col: str = "chunk_bytes") -> DataFrame:
    """Blobs whose bytes don't have the SHA-256 they are filed under."""
    return chunks.filter(F.unhex(F.sha2(bytes_col, 256)) != F.col(hash_col)).select(hash_col)
