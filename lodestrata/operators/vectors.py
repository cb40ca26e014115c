"""Dense vectors: exact nearest neighbours for a query set, rank and score fusion, ranking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BYTES = 32 * 1024 * 1024
BATCH_CELLS = 2 * 1024 * 1024


def knn(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "l2", keep_self: bool = False) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of every query, exactly.

    The query set is read in blocks of at most BLOCK_BYTES, each broadcast; every partition of rows is multiplied with a
    block as matrices. All rows of a batch that may be among a query's k nearest, ties included, are measured again one by
    one and cut to k by (distance, key); these are merged per query. metric: l2, or cosine as 1 - similarity. The smaller
    key wins among equal distances; other dimensions raise; NULL vectors are left out.
    """
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("qv"))
    n, dim = q.agg(F.count(F.lit(1)), F.max(F.size("qv"))).first()
    kind = rows.schema[key].dataType.simpleString()
    out_schema = f"query {kind}, neighbour {kind}, distance double"
    if not n:
        return rows.sparkSession.createDataFrame([], out_schema + ", rank int")
    blocks = max(1, -(-n * dim * 8 // BLOCK_BYTES))
    src = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    found = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toPandas()
        if part.empty:
            continue
        shared = rows.sparkSession.sparkContext.broadcast((part["q"].to_numpy(), np.stack(part["qv"].map(lambda x: np.asarray(x, dtype=np.float64)).to_list())))

        def run(batches, shared=shared):
            ids, m = shared.value
            norm_q, slack = (m**2).sum(1), 8 * (m.shape[1] + 8) * np.finfo(np.float64).eps
            for pdf in batches:
                if pdf.empty:
                    continue
                # in the order of the keys, so that a stable sort by distance leaves the smaller key first
                pdf = pdf.sort_values("k", na_position="first", kind="stable")
                v = np.stack([np.asarray(x, dtype=np.float64) for x in pdf["v"]])
                if v.shape[1] != m.shape[1]:
                    raise ValueError(f"vectors of {v.shape[1]} dimensions, queries of {m.shape[1]}")
                keys, norm_v = pdf["k"].to_numpy(), (v**2).sum(1)
                step = max(1, BATCH_CELLS // len(v))
                for lo in range(0, len(ids), step):
                    own, mq, nq = ids[lo : lo + step], m[lo : lo + step], norm_q[lo : lo + step]
                    scale = np.maximum(np.sqrt(nq)[:, None] * np.sqrt(norm_v)[None], 1e-30)
                    if metric == "cosine":
                        d, err = 1 - (mq @ v.T) / scale, slack
                    else:
                        d, err = nq[:, None] - 2 * (mq @ v.T) + norm_v[None], slack * (nq[:, None] + norm_v[None])
                    d[~np.isfinite(d)] = np.inf
                    if not keep_self:
                        d[own[:, None] == keys[None]] = np.inf
                    # no row beyond the k-th upper bound can be among the k nearest; all others are candidates, however many tie
                    take = min(max(k, 1), d.shape[1])
                    near = (d - err <= np.partition(d + err, take - 1, axis=1)[:, take - 1 : take]) & np.isfinite(d)
                    found_q, found_r, found_d = [], [], []
                    for i in range(len(own)):
                        r = np.flatnonzero(near[i])
                        # matrix products round by position; these sums don't, so equal vectors have equal distances
                        exact = 1 - (v[r] * mq[i]).sum(1) / scale[i, r] if metric == "cosine" else np.sqrt(((v[r] - mq[i]) ** 2).sum(1))
                        first = np.argsort(exact, kind="stable")[:k]
                        found_q.append(np.full(len(first), lo + i))
                        found_r.append(r[first])
                        found_d.append(exact[first])
                    yield pd.DataFrame({"query": ids[np.concatenate(found_q)], "neighbour": keys[np.concatenate(found_r)], "distance": np.concatenate(found_d)})

        got = src.mapInPandas(run, out_schema)
        found = got if found is None else found.unionByName(got)
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def l2_normalize(vector):
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def rrf(lists: list[DataFrame], k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of (query, item, rank) lists: sum of 1 / (k + rank), ranked again by score then item."""
    every = None
    for one in lists:
        part = one.select("query", "item", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    scored = every.groupBy("query", "item").agg(F.sum("s").alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "item")))


def score_fusion(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha * score of a + (1 - alpha) * score of b; a missing score is 0."""
    j = a.select("query", "item", F.col("score").alias("sa")).join(b.select("query", "item", F.col("score").alias("sb")), ["query", "item"], "full")
    return j.select("query", "item", (alpha * F.coalesce("sa", F.lit(0.0)) + (1 - alpha) * F.coalesce("sb", F.lit(0.0))).alias("score"))


def rbf(distance, sigma: float = 2048.0):
    """Kernel score of a distance."""
    return F.exp(-(distance * distance) / (2 * sigma * sigma))


def recall_at_k(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's relevant items among its first k."""
    hit = relevant.join(found.filter(F.col("rank") <= k).select("query", "item", F.lit(1.0).alias("hit")), ["query", "item"], "left")
    return hit.groupBy("query").agg((F.coalesce(F.sum("hit"), F.lit(0.0)) / F.count(F.lit(1))).alias("r")).agg(F.avg("r").alias("recall"))


def jaccard_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean overlap of two rankings' first k items over their union."""
    x, y = a.filter(F.col("rank") <= k).select("query", "item", F.lit(1).alias("a")), b.filter(F.col("rank") <= k).select("query", "item", F.lit(1).alias("b"))
    j = x.join(y, ["query", "item"], "full").groupBy("query").agg((F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias("j"))
    return j.agg(F.avg("j").alias("jaccard"))


def ndcg_at_k(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Mean NDCG with binary relevance."""
    gain = found.filter(F.col("rank") <= k).join(relevant.select("query", "item").distinct(), ["query", "item"]).groupBy("query").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = relevant.select("query", "item").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n")).withColumn("idcg", F.expr(f"aggregate(sequence(1, CAST(least(n, {k}) AS INT)), 0D, (s, i) -> s + 1 / log2(i + 1.0D))"))
    return ideal.join(gain, "query", "left").agg(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in nats of two discrete columns, from their counts."""
    n = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    px, py, total = n.groupBy(x).agg(F.sum("n").alias("nx")), n.groupBy(y).agg(F.sum("n").alias("ny")), n.agg(F.sum("n").alias("t"))
    j = n.join(px, x).join(py, y).crossJoin(F.broadcast(total))  # one row
    return j.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))
