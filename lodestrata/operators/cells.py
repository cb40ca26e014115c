"""Cell complexes as tables: changes, restriction maps, coboundaries of nodes and edges, faces, cohomology."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.graphs import components

MOST_CELLS = 10_000_000  # of a dense matrix that goes to the driver

# ---------------------------------------------------------------- restriction maps: matrices as lists of rows


def project_dim(width: int, coordinate: int) -> list[list[float]]:
    """One coordinate of a stalk."""
    return [[1.0 if i == coordinate else 0.0 for i in range(width)]]


def project_range(width: int, first: int) -> list[list[float]]:
    """The first coordinates of a stalk; more than it has raise."""
    if first > width:
        raise ValueError(f"{first} coordinates of {width}")
    return [[1.0 if i == j else 0.0 for i in range(width)] for j in range(first)]


def identity(width: int) -> list[list[float]]:
    return project_range(width, width)


def weighted(width: int, weights: dict[int, float]) -> list[list[float]]:
    """The weighted sum of some coordinates."""
    return [[float(weights.get(i, 0.0)) for i in range(width)]]


def compose(outer: list[list[float]], inner: list[list[float]]) -> list[list[float]]:
    """outer after inner; sizes that don't fit raise."""
    if any(len(r) != len(inner) for r in outer):
        raise ValueError("sizes of the maps don't fit")
    return [[sum(r[k] * inner[k][j] for k in range(len(inner))) for j in range(len(inner[0]))] for r in outer]


def restricted(stalk: Column, matrix: list[list[float]]) -> Column:
    """The matrix applied to a stalk (an array), as an expression: zero entries cost nothing."""
    rows = []
    for r in matrix:
        terms = [F.lit(w) * stalk[i] for i, w in enumerate(r) if w]
        rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return F.array(*[x.cast("double") for x in rows])


# ---------------------------------------------------------------- changes


def apply_delta(nodes: DataFrame, edges: DataFrame, removed_nodes: DataFrame, removed_edges: DataFrame, added_nodes: DataFrame, added_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The complex after a change: (nodes (node, ...), edges (a, b)).

    Removals come first; a removed node takes its edges along. An added node replaces one of its name; an added edge
    counts only if both its ends are there, and once. Missing removals change nothing.
    """
    kept = nodes.join(removed_nodes.select("node").distinct(), "node", "left_anti")
    kept = kept.join(added_nodes.select("node").distinct(), "node", "left_anti").unionByName(added_nodes.dropDuplicates(["node"]))
    gone = removed_nodes.select("node").distinct()
    old = edges.select("a", "b").distinct().join(removed_edges.select("a", "b").distinct(), ["a", "b"], "left_anti")
    old = old.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
    names = kept.select("node").distinct()
    new = added_edges.select("a", "b").join(names.select(F.col("node").alias("a")), "a", "left_semi").join(names.select(F.col("node").alias("b")), "b", "left_semi")
    return kept, old.select("a", "b").unionByName(new.select("a", "b")).distinct()


# ---------------------------------------------------------------- coboundaries


def coboundary0(edges: DataFrame, stalks: DataFrame, at_a: list[list[float]], at_b: list[list[float]] | None = None) -> DataFrame:
    """(a, b, delta): F_b x_b - F_a x_a of each distinct edge between nodes that have a stalk."""
    left = stalks.select(F.col("node").alias("a"), restricted(F.col("stalk"), at_a).alias("_xa"))
    right = stalks.select(F.col("node").alias("b"), restricted(F.col("stalk"), at_b or at_a).alias("_xb"))
    j = edges.select("a", "b").distinct().join(left, "a").join(right, "b")
    return j.select("a", "b", F.zip_with("_xb", "_xa", lambda x, y: x - y).alias("delta"))


def signed_faces(faces: DataFrame) -> DataFrame:
    """(face, a, b, sign) of faces given as node cycles (face, cycle): each step from a node to the next, the last one
    back to the first; an edge is stored from the smaller to the greater end, so a step against it has sign -1."""
    n = F.size("cycle")
    steps = faces.select("face", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("cycle", i).alias("f"), F.get("cycle", F.pmod(i + 1, n)).alias("t")))).alias("s"))
    return steps.select("face", F.least("s.f", "s.t").alias("a"), F.greatest("s.f", "s.t").alias("b"), F.when(F.col("s.f") < F.col("s.t"), 1.0).otherwise(-1.0).alias("sign"))


def coboundary1(signed: DataFrame, values: DataFrame) -> DataFrame:
    """(face, delta): the signed sum of the values (a, b, delta) of a face's edges, per dimension."""
    j = signed.join(values, ["a", "b"]).select("face", "sign", F.posexplode("delta").alias("dim", "v"))
    sums = j.groupBy("face", "dim").agg(F.sum(F.col("sign") * F.col("v")).alias("v"))
    return sums.groupBy("face").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("delta"))  # an entry per dimension


def cochain_faults(edges: DataFrame, signed: DataFrame, stalks: DataFrame, at: list[list[float]], epsilon: float = 1e-4) -> DataFrame:
    """(face, worst) of the faces on which the coboundary of the coboundary isn't zero: none in a complex whose signs fit."""
    d1 = coboundary1(signed, coboundary0(edges, stalks, at))
    return d1.select("face", F.array_max(F.transform("delta", F.abs)).alias("worst")).filter(F.col("worst") > epsilon)


# ---------------------------------------------------------------- faces


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """(face, cycle): every simple undirected cycle of 3 to `longest` nodes, from its smallest node towards the smaller
    of that one's two neighbours; face is a hash of it.

    Paths grow by a join per length, from their smallest node over greater ones only, so a cycle is met in two
    directions and kept in one. A path is a row of its own: nothing is gathered, but their number is that of the graph's
    paths, as faces of this length are meant for sparse graphs.
    """
    if not 3 <= longest <= 8:
        raise ValueError("cycles have 3 to 8 nodes")
    e = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    both = e.select(F.col("u").alias("f"), F.col("v").alias("t")).unionByName(e.select(F.col("v").alias("f"), F.col("u").alias("t")))
    path, out = e.select(F.array("u", "v").alias("p")), None
    for n in range(3, longest + 1):
        grown = path.withColumn("f", F.element_at("p", -1)).join(both, "f").filter((F.col("t") > F.col("p")[0]) & ~F.array_contains("p", F.col("t")))
        path = grown.select(F.concat("p", F.array("t")).alias("p"))
        closed = path.filter(F.col("p")[1] < F.element_at("p", -1)).join(e, (F.col("p")[0] == F.col("u")) & (F.element_at("p", -1) == F.col("v")), "left_semi")
        out = closed if out is None else out.unionByName(closed)
    return out.select(F.xxhash64("p").alias("face"), F.col("p").alias("cycle"))


def closure(edges: DataFrame) -> DataFrame:
    """Edges a -> c that close a -> b -> c, with the node between: virtual edges of the transitive closure, one step."""
    e = edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct()
    two = e.alias("p").join(e.alias("q"), F.expr("p.b = q.a AND p.a != q.b")).select(F.col("p.a").alias("a"), F.col("q.b").alias("b"), F.col("p.b").alias("via"))
    return two.join(e, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("via").alias("via"))


# ---------------------------------------------------------------- cohomology


def cycle_rank(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_components, cycle_rank) of an undirected graph: edges - nodes + components, with no matrix."""
    e = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    n = components(e).agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    m = e.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(m).select("n_nodes", "n_edges", "n_components", (F.col("n_edges") - F.col("n_nodes") + F.col("n_components")).alias("cycle_rank"))  # single rows


def h1_dimension(edges: DataFrame, signed: DataFrame) -> int | None:
    """Independent cycles that no face bounds, for identity maps of one dimension; 0 without faces, as the surface has it.

    The rank of the coboundary of nodes needs no matrix (nodes - components); that of edges is taken in the driver if
    faces x edges stays within MOST_CELLS, which counts say first, and the result is None beyond.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    n_faces = signed.select("face").distinct().count()
    if not n_faces:
        return 0
    r = cycle_rank(e).first()
    if n_faces * r["n_edges"] > MOST_CELLS:
        return None
    index = {(x["a"], x["b"]): i for i, x in enumerate(e.collect())}
    rows: dict = {}
    for x in signed.collect():
        if (x["a"], x["b"]) in index:
            rows.setdefault(x["face"], np.zeros(len(index)))[index[x["a"], x["b"]]] += x["sign"]
    rank1 = int(np.linalg.matrix_rank(np.array(list(rows.values())))) if rows else 0
    return max(0, r["n_edges"] - rank1 - (r["n_nodes"] - r["n_components"]))
