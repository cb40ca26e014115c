"""Graphs and cell complexes: components, traversal, coboundary, violations, change impact, restriction keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Workspace

DENSE_LIMIT = 10_000_000
EPSILON = 1e-4


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node with an edge.

    Alternates large-star and small-star steps, whose rounds grow with the log of the size and which move each edge to
    smaller nodes; a hub's edges are minimised by partial aggregation, never gathered. Edges are written per round.
    """
    ws = Workspace(edges.sparkSession, "components")
    cur = ws.write(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())
    while True:
        both = cur.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(cur.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("root"))
        large = both.filter(F.col("m") > F.col("n")).join(least, "n").select(F.col("root").alias("lo"), F.col("m").alias("hi")).filter("lo != hi").unionByName(cur.filter("lo = hi")).distinct()
        low = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("root"))
        small = large.join(low, F.col("hi") == F.col("n"))
        nxt = small.select(F.col("root").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("root").alias("lo"), F.col("n").alias("hi"))).select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo != hi").distinct()
        nxt = ws.write(nxt)
        same = nxt.count() == cur.filter("lo != hi").count() and nxt.join(cur, ["lo", "hi"], "left_anti").limit(1).count() == 0
        if not same:
            ws.drop(cur)
            cur = nxt
            continue
        break
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).filter(F.col("node").isNotNull()).distinct()
    return nodes.join(nxt.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, depth): nodes within max_depth undirected steps of the start nodes (column node), each at its least depth."""
    ws = Workspace(edges.sparkSession, "bfs")
    both = edges.select(F.col(a).alias("f"), F.col(b).alias("t")).unionByName(edges.select(F.col(b).alias("f"), F.col(a).alias("t"))).distinct()
    front = ws.write(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for d in range(1, max_depth + 1):
        nxt = ws.write(both.join(front.select(F.col("node").alias("f")), "f", "left_semi").select(F.col("t").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if not nxt.limit(1).count():
            break
        seen, front = seen.unionByName(nxt), nxt
    return seen


def triangles(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(x, y, z) with x < y < z: the 2-cells closed by three edges.

    Edges point from the end of smaller degree, so no node has more than sqrt(2 |E|) outgoing ones and a hub makes no
    quadratic number of wedges.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    deg = e.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    d = e.join(deg.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    turn = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = d.select(F.when(turn, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(turn, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedge = o.alias("p").join(o.alias("q"), F.expr("p.s = q.s AND p.t < q.t")).select(F.col("p.s").alias("s"), F.col("p.t").alias("x"), F.col("q.t").alias("y"))
    closed = wedge.join(e, (F.col("x") == F.col("u")) & (F.col("y") == F.col("v")))
    s = F.array_sort(F.array("s", "x", "y"))
    return closed.select(s[0].alias("x"), s[1].alias("y"), s[2].alias("z"))


def coboundary(edges: DataFrame, stalks: DataFrame, a: str = "a", b: str = "b", node: str = "node", stalk: str = "stalk", restriction=None) -> DataFrame:
    """(a, b, delta): F_b x_b - F_a x_a per edge. restriction: a Column function of a stalk, identity by default."""
    f = restriction or (lambda x: x)
    left = stalks.select(F.col(node).alias(a), F.col(stalk).alias("_xa"))
    right = stalks.select(F.col(node).alias(b), F.col(stalk).alias("_xb"))
    j = edges.select(a, b).distinct().join(left, a).join(right, b)
    return j.select(a, b, F.zip_with(f(F.col("_xb")), f(F.col("_xa")), lambda x, y: (x - y).cast("double")).alias("delta"))


def violations(delta: DataFrame, a: str = "a", b: str = "b", epsilon: float = EPSILON) -> DataFrame:
    return delta.select(a, b, F.posexplode("delta").alias("dim", "value")).filter(F.abs("value") > epsilon)


def defects(delta: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Squared length of the coboundary of each edge."""
    return delta.select(a, b, F.aggregate("delta", F.lit(0.0), lambda s, x: s + x * x).alias("defect"))


def consistency(defect: DataFrame, nodes: DataFrame, threshold: float, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """(node, component) of the graph of edges whose defect is below the threshold; lone nodes are their own group."""
    agree = defect.filter(F.col("defect") < threshold).select(a, b)
    c = components(agree, a, b).withColumnRenamed("node", "_n")
    return nodes.select(node).distinct().join(c, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("component", node).alias("component"))


def h0_dimension(edges: DataFrame, nodes: DataFrame, stalk_dim: int) -> int | None:
    """Dimension of global sections for identity restrictions: columns minus rank of the coboundary; None beyond the limit.

    The matrix goes to the driver only below DENSE_LIMIT elements, which is checked by counts first.
    """
    n, m = nodes.count(), edges.count()
    if n * stalk_dim * m * stalk_dim > DENSE_LIMIT:
        return None
    index = {r[0]: i for i, r in enumerate(nodes.distinct().collect())}
    mat = np.zeros((m * stalk_dim, len(index) * stalk_dim), dtype=np.float32)
    for r, e in enumerate(edges.collect()):
        for d in range(stalk_dim):
            mat[r * stalk_dim + d, index[e[0]] * stalk_dim + d] -= 1
            mat[r * stalk_dim + d, index[e[1]] * stalk_dim + d] += 1
    return len(index) * stalk_dim - (int(np.linalg.matrix_rank(mat)) if m else 0)


def restriction_keys(refs: DataFrame, by: str = "source_id") -> DataFrame:
    """A key per file over its sorted distinct call targets: equal keys mean that a review by call targets may be skipped."""
    rows = refs.filter(F.col(by).isNotNull()).select(by, F.concat_ws("\x1f", F.coalesce("token", F.lit("")), F.coalesce("qualifier", F.lit(""))).alias("r")).distinct()
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), "\n"), 256).alias("restriction_key"), F.count(F.lit(1)).alias("n_targets"))


def touched_regions(regions: DataFrame, changed: DataFrame) -> DataFrame:
    """Regions with a label that is a changed file or a symbol of one (`file:sym:name`)."""
    r = regions.withColumn("file", F.substring_index("label", ":sym:", 1))
    return r.join(changed.select("file").distinct(), "file", "left_semi").select("region").distinct()


def granularity(violation: DataFrame, nodes: DataFrame) -> DataFrame:
    """Advice: the largest violation, per-node below 0.1 else per-file, distributed from 8 cells on."""
    worst = violation.agg(F.coalesce(F.max(F.abs("value")), F.lit(0.0)).alias("worst"))
    cells = nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("n_cells"))
    return worst.crossJoin(cells).select("worst", "n_cells", F.when(F.col("worst") < 0.1, "per-node").otherwise("per-file").alias("granularity"), (F.col("n_cells") >= 8).alias("distributed"))  # single rows
