"""Binary hypervectors as arrays of 64-bit words: distance, bundling, rotation, radius search, calibration, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import Workspace

HV_BYTES = 1024
HV_BITS = 8 * HV_BYTES
BLOCK_ROWS = 2048
# Layers in the order of their role.
LAYERS = ("ast", "module", "semantic", "temporal", "hir", "lex", "fs")


def splitmix64(state: int) -> tuple[int, int]:
    """Next state and output of the SplitMix64 generator."""
    m = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & m
    z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return state, z ^ (z >> 31)


def expand_seed(seed: int, words: int = HV_BYTES // 8) -> np.ndarray:
    """A pseudo-random hypervector of little-endian words."""
    out, s = np.empty(words, dtype="<u8"), seed & ((1 << 64) - 1)
    for i in range(words):
        s, out[i] = splitmix64(s)
    return out


def rotate_bits(words: np.ndarray, n: int) -> np.ndarray:
    """Circular shift of the whole vector by n bits towards higher positions (negative: lower)."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")
    return np.packbits(np.roll(bits, n), bitorder="little").view("<u8")


def popcount_xor(a: Column, b: Column) -> Column:
    """Hamming distance of two word arrays; raises on different lengths; NULL if one is."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), d).when(a.isNull() | b.isNull(), F.lit(None).cast("int")).otherwise(F.raise_error(F.lit("hypervectors differ in length")).cast("int"))


def xor_words(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def words_of(hv: Column) -> Column:
    """Words of a binary vector; NULL for lengths that aren't whole words."""

    @F.pandas_udf("array<bigint>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: None if b is None or len(b) % 8 else np.frombuffer(b, dtype="<i8"))

    return run(hv)


def rotate(words: Column, by: Column) -> Column:
    """Rotation of a word array by a number of bits, as an Arrow UDF."""

    @F.pandas_udf("array<bigint>")
    def run(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else rotate_bits(np.asarray(x, dtype="<i8").view("<u8"), int(k)).view("<i8") for x, k in zip(w, n)])

    return run(words, by)


def sign_words(vector: Column, dims: int) -> Column:
    """Words of the signs of a dense vector: bit i is set where component i is positive."""
    words = []
    for lo in range(0, dims, 64):
        bits = [F.when(vector[i] > 0, F.lit(1 << (i - lo) if i - lo < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(lo, min(lo + 64, dims))]
        w = bits[0]
        for b in bits[1:]:
            w = w.bitwiseOR(b)
        words.append(w)
    return F.array(*words)


def bundle(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """XOR of the vectors of each group: one partial XOR per word and map task, no list of vectors anywhere."""
    per = df.select(*keys, F.posexplode(words).alias("_pos", "_w")).groupBy(*keys, "_pos").agg(F.bit_xor("_w").alias("_w"))
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_w"))).alias("_a"))  # as many as words
    return packed.select(*keys, F.transform("_a", lambda x: x["_w"]).alias(words))


def bundle_majority(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Bit-wise majority per group: set where more than half (floor) of the vectors have it, ties are 0.

    Counts per (group, word, bit) are added up with partial aggregation, then bits are packed again.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bits = df.select(*keys, F.posexplode(words).alias("_pos", "_w"))
    per = bits.groupBy(*keys, "_pos").agg(*[F.sum(F.shiftrightunsigned("_w", b).bitwiseAND(F.lit(1))).alias(f"_c{b}") for b in range(64)])
    j = per.join(n, keys) if keys else per.crossJoin(n)
    w = F.lit(0).cast("long")
    for b in range(64):
        w = w.bitwiseOR(F.when(F.col(f"_c{b}") > F.floor(F.col("_n") / 2), F.lit((1 << b) if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    packed = j.select(*keys, "_pos", w.alias("_w")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_w"))).alias("_a"))
    return packed.select(*keys, F.transform("_a", lambda x: x["_w"]).alias(words))


def combined(df: DataFrame, scope: str, layer: str, words: str) -> DataFrame:
    """One vector per scope: each layer's vector rotated by the layer's index, all XORed. Unknown layers are left out."""
    idx = F.create_map(*[F.lit(x) for i, name in enumerate(LAYERS) for x in (name, i)])[F.col(layer)]
    turned = df.withColumn("_i", idx).filter(F.col("_i").isNotNull()).withColumn(words, rotate(F.col(words), F.col("_i")))
    return bundle(turned, [scope], words)


def radius_top_k(df: DataFrame, query: list[int], words: str, key: str, radius: int, k: int) -> DataFrame:
    """The k nearest rows within a Hamming radius of one vector; the smaller key among equals."""
    q = F.array(*[F.lit(w).cast("long") for w in query])
    return df.select(key, popcount_xor(F.col(words), q).alias("distance")).filter(F.col("distance") <= radius).orderBy("distance", key).limit(k)


def density(df: DataFrame, query: list[int], words: str, radius: int) -> DataFrame:
    q = F.array(*[F.lit(w).cast("long") for w in query])
    return df.filter(popcount_xor(F.col(words), q) <= radius).agg(F.count(F.lit(1)).alias("n"))


def median_and_mad(distances: DataFrame, d: str, keys: list[str]) -> DataFrame:
    """Lower median and the lower median of deviations from it, per group of pair distances."""
    med = distances.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {d})").cast("long").alias("median"), F.count(F.lit(1)).alias("sample_size"))
    dev = distances.join(F.broadcast(med), keys) if keys else distances.crossJoin(F.broadcast(med))  # a row per layer
    return dev.groupBy(*keys, "median", "sample_size").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({d} - median))").cast("long").alias("mad"))


def _pair_blocks(df: DataFrame, words: str, key: str, by: str):
    """Rows of each group in blocks of about BLOCK_ROWS, grouped by pair of blocks; rows without group or vector are left out."""
    src = df.filter(F.col(by).isNotNull() & F.col(words).isNotNull()).select(F.col(by).alias("by"), F.col(key).alias("k"), F.col(words).alias("w"))
    n = src.groupBy("by").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    own = src.join(F.broadcast(n), "by").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))  # a row per layer
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.select("by", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "k", "w").groupBy("by", "lo", "hi")


def _pair_distances(pdf: pd.DataFrame):
    """(rows, columns, distances, which are pairs) of a few rows at a time; each pair of the two blocks once, as positions in pdf."""
    w = np.stack(pdf["w"].to_list()).astype("<i8").view("<u8")
    own, lo, hi = pdf["own"].to_numpy(), pdf["lo"].iat[0], pdf["hi"].iat[0]
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    for s in range(0, len(left), 256):
        rows = left[s : s + 256]
        d = np.zeros((len(rows), len(right)), dtype=np.int32)
        for i in range(w.shape[1]):
            d += np.bitwise_count(w[rows, i][:, None] ^ w[right, i][None])
        yield rows, right, d, rows[:, None] < right[None] if lo == hi else np.ones(d.shape, dtype=bool)


def pair_distances(df: DataFrame, words: str, key: str, by: str) -> DataFrame:
    """(by, d, n): how many of all pairs of one group have Hamming distance d. Pairs are counted block by block, never moved."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.bincount(d[ok], minlength=64 * len(pdf["w"].iat[0]) + 1) for _, _, d, ok in _pair_distances(pdf))
        at = np.flatnonzero(n)
        return pd.DataFrame({"by": [pdf["by"].iat[0]] * len(at), "d": at, "n": np.asarray(n)[at]})

    kind = df.schema[by].dataType.simpleString()
    return _pair_blocks(df, words, key, by).applyInPandas(run, f"by {kind}, d int, n long").groupBy(F.col("by").alias(by), "d").agg(F.sum("n").alias("n"))


def median_and_mad_of_counts(counts: DataFrame, by: str) -> DataFrame:
    """`median_and_mad` per group over counted distances (by, d, n); a window holds one row per distance."""

    def median(df: DataFrame, d: str, name: str) -> DataFrame:
        up, every = W.partitionBy(by).orderBy(d), W.partitionBy(by)
        half = df.withColumn("_up", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(every)).filter(2 * F.col("_up") >= F.col("_all"))
        return half.groupBy(by).agg(F.min(d).cast("long").alias(name), F.max("_all").alias("sample_size"))

    med = median(counts, "d", "median")
    dev = counts.join(med.select(by, "median"), by).groupBy(by, F.abs(F.col("d") - F.col("median")).alias("d")).agg(F.sum("n").alias("n"))
    return med.join(median(dev, "d", "mad").select(by, "mad"), by)


def radius_edges(df: DataFrame, words: str, key: str, by: str, radius: int) -> DataFrame:
    """(a, b, defect): pairs of one group within a Hamming radius that connect whatever all such pairs connect.

    Every pair of rows is compared, block against block; of the pairs within the radius each two blocks give a spanning
    forest, so that dense groups don't yield a quadratic number of edges.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, root, out = pdf["k"].to_numpy(), np.arange(len(pdf)), []
        for rows, right, d, ok in _pair_distances(pdf):
            for i, near, dist in zip(rows, ok & (d <= radius), d):
                at = np.flatnonzero(near)
                roots, first = np.unique(root[right[at]], return_index=True)
                new = roots != root[i]
                out += [(keys[i], keys[right[at[f]]], int(dist[at[f]])) for f in first[new]]
                root[np.isin(root, roots[new])] = root[i]
        return pd.DataFrame(out, columns=["a", "b", "defect"])

    kind = df.schema[key].dataType.simpleString()
    return _pair_blocks(df, words, key, by).applyInPandas(run, f"a {kind}, b {kind}, defect int")


def calibrate(df: DataFrame, words: str, key: str, sample: int = 1000, seed: int = 7) -> DataFrame | None:
    """Median and MAD of the distances of random pairs, drawn with replacement by SplitMix64; None below two rows.

    Rows are numbered by their key; the pairs (at most `sample`, a parameter, or all there are) are made on the driver and
    joined to the vectors twice.
    """
    spark: SparkSession = df.sparkSession
    n = df.count()
    if n < 2:
        return None
    target, s, pairs = min(sample, n * (n - 1) // 2), seed, []
    while len(pairs) < target:
        s, a = splitmix64(s)
        s, b = splitmix64(s)
        if a % n != b % n:
            pairs.append((len(pairs), a % n, b % n))
    p = spark.createDataFrame(pairs, "pair long, i long, j long")
    wanted = spark.createDataFrame([(x,) for x in sorted({x for _, i, j in pairs for x in (i, j)})], "i long")
    # a global number per row needs the position within sorted partitions, which no column expression gives
    # a row's number is its place in its range of keys plus the rows of the ranges before, so nothing is ordered in one task
    ws = Workspace(spark, "calibrate")
    ranged = ws.write(df.select(F.col(key).alias("_k"), F.col(words).alias("w")).repartitionByRange("_k").withColumn("part", F.spark_partition_id()))
    before, total = [], 0
    for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row per partition
        before.append((r["part"], total))
        total += r["n"]
    place = F.row_number().over(W.partitionBy("part").orderBy("_k")) - 1
    at = ranged.withColumn("place", place).join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    numbered = at.select((F.col("before") + F.col("place")).alias("i"), "w").join(F.broadcast(wanted), "i", "left_semi")
    d = p.join(numbered, "i").select("pair", "j", F.col("w").alias("a")).join(numbered.select(F.col("i").alias("j"), F.col("w").alias("b")), "j")
    return median_and_mad(d.select(popcount_xor(F.col("a"), F.col("b")).alias("d")), "d", [])


def register(spark: SparkSession) -> None:
    """The surface's SQL functions: popcount_xor (scalar), bundle and bundle_majority (aggregates) over binary vectors."""

    @F.pandas_udf("int")
    def pop(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if len(x) != len(y):
                raise ValueError("hypervectors differ in length")
            out.append(int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()))
        return pd.Series(out, dtype="Int32")

    @F.pandas_udf("binary")
    def xor(v: pd.Series) -> bytes:
        rows = [np.frombuffer(x, np.uint8) for x in v if x is not None]
        return np.bitwise_xor.reduce(rows).tobytes() if rows else None

    @F.pandas_udf("binary")
    def majority(v: pd.Series) -> bytes:
        rows = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in v if x is not None]
        return np.packbits(np.sum(rows, axis=0) > len(rows) // 2, bitorder="little").tobytes() if rows else None

    spark.udf.register("popcount_xor", pop)
    spark.udf.register("bundle", xor)
    spark.udf.register("bundle_majority", majority)
