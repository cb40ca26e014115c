"""Mixing sources to target shares of all tokens: Sainte-Lague quotas of equal blocks, then seeded block selection."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.tokens import TOKENIZERS, encode
from lodestrata.session import Workspace


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """Seats per name by highest quotients weight / (2 k + 1), none above most[name]; ties go to the smaller name.

    A common divisor found by bisection gives all but a few seats at once; the rest go out one by one from a heap, so
    the cost doesn't depend on the number of seats. Names of weight 0 get none. If all are full, seats stay unassigned.
    """
    live = {k: w for k, w in weights.items() if w and w > 0 and (most is None or most.get(k, 0) > 0)}
    cap = lambda k: math.inf if most is None else most.get(k, 0)
    got = dict.fromkeys(weights, 0)
    if not live or seats <= 0:
        return got
    at = lambda d: {k: int(min(cap(k), max(0, math.floor(w / d + 0.5)))) for k, w in live.items()}
    lo, hi = 0.0, 2 * max(live.values()) + 1.0  # at hi nobody has a seat, towards lo everybody is full
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(at(mid).values()) > seats:
            lo = mid
        else:
            hi = mid
    got |= at(hi * (1 + 1e-9))  # equal quotients at the divisor itself are left to the heap, in order of names
    heap = [(-w / (2 * got[k] + 1), k) for k, w in live.items() if got[k] < cap(k)]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < cap(k):
            heapq.heappush(heap, (-live[k] / (2 * got[k] + 1), k))
    return got


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total: int | None = None,
    seed: int = 17,
    block: int = 256,
    shard_tokens: int = 1 << 28,
    shard_rows: int = 2_000_000,
    vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken",
) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, repeats >= 1) and its report per source.

    total: tokens wanted; by default the most with which every source that has tokens can hold its share within
    max_repeats. A source without tokens can't contribute; its share is divided over the others in proportion, and the
    report shows 0 for it. NULL, empty and blank-free texts of 0 tokens are never chosen; documents of NULL sources or
    of sources without a target neither; of a repeated target row the greatest holds. A source that can't reach its
    share of a given `total` is used max_repeats times in full and the report says so.

    1. Tokens of every document are counted once and written. 2. Each source is cut into shards by a seeded hash, of about
    shard_tokens tokens or shard_rows rows, whichever is less, so that no source's rows are one task and the driver holds
    a row per shard (100,000 of them at 25 trillion tokens). 3. Blocks of `block` tokens, whatever the corpus, are
    apportioned to sources by Sainte-Lague, capped by what max_repeats allows, then each source's blocks to its shards. 4. In a shard, rows in seeded order are cut into blocks by their
    running tokens; a quota of q blocks over b takes all rows q // b times, and the first q mod b blocks once more.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "mix")
    t = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    goal = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in t.collect()}  # a row per source
    docs = documents.select("doc_id", "text", "source").filter(F.col("source").isNotNull() & F.col("text").isNotNull())
    key = F.struct("doc_id", "source").alias("k")
    counted = encode(docs.join(F.broadcast(t.select("source")), "source").select(key, "text"), "k", "text", vocabulary, ids=False)
    counted = ws.write(counted.filter("n_tokens > 0").select("k.doc_id", "k.source", "n_tokens"))
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # a row per source
    have, held = {r["source"]: r["n"] for r in sums}, {r["source"]: r["rows"] for r in sums}
    usable = {s: share for s, (share, reps) in goal.items() if share > 0 and reps > 0 and have.get(s)}
    norm = sum(usable.values())
    if total is None:
        total = math.floor(min((goal[s][1] * have[s] * norm / share for s, share in usable.items()), default=0))
    shards = {s: max(math.ceil(have[s] / shard_tokens), math.ceil(held[s] / shard_rows)) for s in usable}
    lists = F.create_map(*[F.lit(x) for s in sorted(shards) for x in (s, shards[s])]) if shards else F.lit(None).cast("map<string,int>")
    rank = F.xxhash64(F.lit(seed), "doc_id", "source")
    rows = counted.withColumn("n_shards", lists[F.col("source")]).filter(F.col("n_shards").isNotNull())
    rows = rows.withColumn("rank", rank).withColumn("shard", F.pmod(F.xxhash64("rank", F.lit(seed + 1)), F.col("n_shards")).cast("int"))
    order = W.partitionBy("source", "shard").orderBy("rank", "doc_id")
    rows = rows.withColumn("block", F.floor((F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens") / 2) / block))
    rows = ws.write(rows.drop("n_shards", "rank"))
    sizes = {(r[0], r[1]): (r[2], r[3]) for r in rows.groupBy("source", "shard").agg(F.sum("n_tokens"), F.max("block")).collect()}  # a row per shard
    blocks = {k: max(1, math.ceil(n / block)) for k, (n, _) in sizes.items()}
    room = {s: sum(b for (x, _), b in blocks.items() if x == s) * goal[s][1] for s in usable}
    quota = sainte_lague(usable, total // block, room)
    plan = []
    for s in usable:
        own = {k: n for k, (n, _) in sizes.items() if k[0] == s}
        for k, q in sainte_lague(own, quota[s], {k: blocks[k] * goal[s][1] for k in own}).items():
            plan.append((*k, q // blocks[k], q % blocks[k]))
    per_shard = spark.createDataFrame(plan, "source string, shard int, full int, extra int")
    repeats = F.col("full") + (F.col("block") < F.col("extra")).cast("int")
    chosen = rows.join(F.broadcast(per_shard) if len(plan) <= 200_000 else per_shard, ["source", "shard"]).withColumn("repeats", repeats).filter("repeats > 0")
    chosen = chosen.select("doc_id", "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    report = t.join(used, "source", "left").na.fill(0, ["tokens", "n_docs", "most_repeats"])
    everything = report.agg(F.sum("tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(everything)).select(  # one row
        "source", "target_share", "max_repeats", "n_docs", "tokens", "most_repeats", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share")
    )
    return chosen, report
