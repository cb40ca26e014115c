"""Per-key results without imbalance: value-frequency compression and exact joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Workspace


def heavy_keys(keys: DataFrame, key: str, rows: str, total: int, share: float = 1e-3) -> DataFrame:
    """Keys with at least `share` of `total` rows. At most 1/share rows, so the result may be broadcast."""
    return keys.filter(F.col(rows) >= F.lit(max(1.0, share * total))).select(key)


def salted_join(big: DataFrame, keyed: DataFrame, key: str, heavy: DataFrame, salts: int, tie: str) -> DataFrame:
    """Exact inner equi-join of big with keyed (one row per key) whose heavy keys are spread over `salts` partitions.

    heavy: keys from `heavy_keys`, broadcast (its size is bounded by 1/share rows). Rows of big with a heavy key get
    the salt hash(tie) mod salts; the one row of keyed is repeated per salt, for heavy keys only. Other keys keep salt 0.
    NULL keys join nothing.
    """
    h = F.broadcast(heavy.select(F.col(key).alias("_hk")))
    left = big.join(h, F.col(key) == F.col("_hk"), "left").withColumn(
        "_salt", F.when(F.col("_hk").isNotNull(), F.pmod(F.xxhash64(tie), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    right = (
        keyed.withColumnRenamed(key, "_rk")
        .join(h, F.col("_rk") == F.col("_hk"), "left")
        .withColumn("_rs", F.explode(F.when(F.col("_hk").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hk")
    )
    return left.drop("_hk").join(right, (F.col(key) == F.col("_rk")) & (F.col("_salt") == F.col("_rs"))).drop("_rk", "_rs", "_salt")


def compress(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """Value-frequency table (key, what, value, weight): how often each value occurs with each key.

    values: name of the result -> column. The group key is (key, what, value), so a hot key is spread over as many
    partitions as it has values, and a value that repeats is folded before the shuffle. NULL keys and NULL values are
    kept as groups of their own, so weights add up to the rows of each key for each `what`.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("what"), F.col(c).cast("string").alias("value")) for i, c in enumerate(values.values())])
    return (
        df.select(F.col(key).alias("_key"), F.explode(pairs).alias("_p"))
        .groupBy("_key", F.col("_p.what").alias("what"), F.col("_p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def per_key_profile(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """Exact rows and distinct counts per key: columns key, rows, n_<name> for each name of `values`.

    Second step over `compress`: grouped by key with partial aggregation, so each task sends one row per key it holds.
    NULL values count as rows but not as distinct values; the NULL key is a group; an empty table gives no rows.
    """
    freq = compress(df, key, values)
    aggs = [F.sum(F.when(F.col("what") == 0, F.col("weight"))).alias("rows")] + [
        F.count(F.when((F.col("what") == i) & F.col("value").isNotNull(), 1)).alias(f"n_{name}") for i, name in enumerate(values)
    ]
    return freq.groupBy("_key").agg(*aggs).withColumnRenamed("_key", key)


def per_key_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-NULL value per key, the smallest among equals: key, mode, mode_rows."""
    freq = compress(df, key, {"v": value}).filter(F.col("value").isNotNull())
    best = freq.groupBy("_key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "value")).alias("b"))
    return best.select(F.col("_key").alias(key), F.col("b.value").alias("mode"), (-F.col("b.w")).alias("mode_rows"))


BLOCKS = 64


def per_key_percentile(df: DataFrame, key: str, value: str, q: float = 0.5, salts: int = 32) -> DataFrame:
    """Exact lower percentile per key of a numeric column from weighted values: key, percentile.

    The smallest value whose cumulated weight reaches q of the key's rows. Per key the distinct values are cut into 64
    blocks at their own approximate percentiles, the weights of blocks are summed, and the block that holds the answer
    is cut again, until it has at most 64 distinct values in every key; only those are put in order. Blocks hold about
    equally many values however these are spread, so the rounds grow with the logarithm of their number to the base
    64. Keys with many distinct values are salted where values meet their key's block. NULL values count for nothing,
    the NULL key is a key; an empty table gives no rows.
    """
    ws = Workspace(df.sparkSession, "percentile")
    at = F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
    freq = df.filter(F.col(value).isNotNull()).groupBy(at.alias("_at"), F.col(key).alias("_key"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    freq = ws.write(freq)
    total = freq.count()
    per = freq.groupBy("_at").agg(F.first("_key").alias("_key"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("values"))
    state = ws.write(per.select("_at", "_key", "lo", "hi", F.greatest(F.ceil(F.col("n") * q), F.lit(1)).cast("long").alias("need"), "values"))

    def inside(state: DataFrame) -> DataFrame:
        heavy = heavy_keys(state, "_at", "values", total)
        hit = salted_join(freq.select("_at", "v", "w"), state, "_at", heavy, salts, "v")
        return hit.filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))

    cuts = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    while (state.agg(F.max("values")).first()[0] or 0) > BLOCKS:
        wide = state.filter(F.col("values") > BLOCKS)
        held = inside(wide)
        at_ = held.groupBy("_at").agg(F.percentile_approx("v", cuts, 10_000).alias("cuts"))
        rows = salted_join(held, at_, "_at", heavy_keys(wide, "_at", "values", total), salts, "v")
        block = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        sums = rows.groupBy("_at", block.alias("b")).agg(F.first("_key").alias("_key"), F.first("need").alias("need"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("values"))
        packed = sums.groupBy("_at").agg(F.first("_key").alias("_key"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("b", "lo", "hi", "w", "values"))).alias("a"))  # at most 64 entries
        before = F.expr("transform(sequence(1, size(a)), i -> aggregate(slice(a, 1, i - 1), 0L, (s, x) -> s + x.w))")
        hit = F.expr("filter(zip_with(a, c, (x, y) -> struct(x.lo AS lo, x.hi AS hi, x.w AS w, x.values AS values, y AS c)), z -> z.c < need AND z.c + z.w >= need)[0]")
        cut = packed.withColumn("c", before).withColumn("h", hit).select("_at", "_key", F.col("h.lo").alias("lo"), F.col("h.hi").alias("hi"), (F.col("need") - F.col("h.c")).alias("need"), F.col("h.values").alias("values"))
        nxt = ws.write(cut.unionByName(state.filter(F.col("values") <= BLOCKS)))
        ws.drop(state)
        state = nxt
    last = inside(state).groupBy("_at").agg(F.first("_key").alias("_key"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("v", "w"))).alias("a"))  # at most 64 entries
    pick = F.expr("aggregate(a, struct(CAST(0 AS BIGINT) AS c, CAST(NULL AS DOUBLE) AS r), (s, x) -> struct(s.c + x.w AS c, CASE WHEN s.r IS NULL AND s.c + x.w >= need THEN x.v ELSE s.r END AS r)).r")
    return last.select(F.col("_key").alias(key), pick.alias("percentile"))
