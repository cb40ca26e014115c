"""Queries do the whole job: cases that lie outside of what was once cut off, against plain versions."""

import itertools
import random

import numpy as np
import pytest

import __spark_entry__ as E
from lodestrata.operators import graphs as G
from lodestrata.operators import hypervectors as H
from lodestrata.operators import observations as O
from lodestrata.operators import vectors as K


@pytest.fixture
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def reach(edges, start, depth):
    seen, front = {start: 0}, {start}
    for k in range(1, depth + 1):
        front = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in front} - set(seen)
        seen |= dict.fromkeys(front, k)
    return seen


def test_graph_queries_use_all_rows(spark, tables):
    pairs = [(1, 250), (250, 400), (1, 400), (2, 250), (7, 7), (400, 900), (1, 900)]
    d = tables("lineitem", [(s, p, 50.0) for s, p in pairs], "l_suppkey long, l_partkey long, l_quantity double")
    edges = {frozenset(p) for p in pairs if p[0] != p[1]}
    want = [t for t in itertools.combinations(sorted({x for p in pairs for x in p}), 3) if all(frozenset(p) in edges for p in itertools.combinations(t, 2))]
    assert sorted(map(tuple, E.queries()["graph_triangles_all"](spark, d).collect())) == want == [(1, 250, 400), (1, 400, 900)]

    events = [(5, 1000), (5, 1097), (1000, 6), (6, 2000), (2000, 8)]
    d = tables("events", [(u, e, "view") for u, e in events], "user_id long, event_id long, event_type string")
    assert {r.node: r.depth for r in E.queries()["graph_bfs_all"](spark, d).collect()} == reach(events, 5, 3)


def test_order_queries_use_all_rows(spark, tables):
    # 1 and 1001, 3 and 503 would be one key if folded
    orders = [(1, 10, 9.0, "2-HIGH"), (1001, 20, 9.0, "3-MEDIUM"), (3, 10, 9.0, "1-URGENT"), (503, 11, 400000.0, "2-HIGH")]
    d = tables("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    q = E.queries()
    got = {r.node: r.component for r in q["graph_components_all"](spark, d).collect()}
    assert got == {10: -4, -2: -4, -4: -4, 20: -1002, -1002: -1002, 11: -504, -504: -504}
    moved = [(c, k) for k, c, _, p in orders if p != "1-URGENT"]
    assert {r.region: r.depth for r in q["sheaf_cascade_all"](spark, d).collect()} == reach(moved, 10, 3)
    assert {r.region: r.depth for r in q["sheaf_reap_all"](spark, d).collect()} == {x: 0 for e in moved for x in e}
    r = q["sheaf_cache_defect_all"](spark, d).first()
    assert (r.defect, r.n_moved) == (pytest.approx(0.9 + 0.9 + 0.7), 3)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_keeps_the_smaller_keys_of_many_ties(spark, metric):
    rng = np.random.default_rng(5)
    copy = [float(x) for x in rng.normal(size=64)]
    rows = [(i, copy if i % 3 == 0 else [float(x) for x in rng.normal(size=64)]) for i in range(1500)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(2)
    q = df.filter("vec_id in (0, 9, 600)")
    same = list(range(0, 1500, 3))
    for batch in ("10000", "77"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r.query, r["rank"]): r.neighbour for r in K.knn(q, df, 5, metric=metric).collect()}
            text = df.select(df.vec_id.cast("string").alias("vec_id"), "embedding")
            named = {(r.query, r["rank"]): r.neighbour for r in K.knn(text.filter("vec_id = '0'"), text, 5, metric=metric).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {(x, k + 1): y for x in (0, 9, 600) for k, y in enumerate([y for y in same if y != x][:5])}
        assert named == {("0", k + 1): y for k, y in enumerate(sorted(map(str, same[1:]))[:5])}


def test_hypervector_pairs_are_all_compared(spark, monkeypatch, tables):
    rng = random.Random(8)
    rows = [(i * 3, i % 2, [rng.getrandbits(64) - 2**63 for _ in range(2)]) for i in range(60)]
    rows += [(1000 + i, 0, rows[2 * i][2][:1] + [rows[2 * i][2][1] ^ 5]) for i in range(9)] + [(2000, None, rows[0][2]), (2001, 7, rows[0][2])]
    df = spark.createDataFrame(rows, "k int, label int, w array<bigint>")
    monkeypatch.setattr(H, "BLOCK_ROWS", 11)
    dist = {(a[0], b[0]): sum((x ^ y).bit_count() if x ^ y >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] is not None}
    label = {r[0]: r[1] for r in rows}
    want = {}
    for x in (0, 1):
        ds = sorted(d for (a, _), d in dist.items() if label[a] == x)
        med = ds[(len(ds) - 1) // 2]
        want[x] = (med, len(ds), sorted(abs(d - med) for d in ds)[(len(ds) - 1) // 2])
    assert {r.label: (r.median, r.sample_size, r.mad) for r in H.median_and_mad_of_counts(H.pair_distances(df, "w", "k", "label"), "label").collect()} == want

    for radius in (2, 48):
        group = {k: k for k in label}
        for (a, b), d in dist.items():
            if d <= radius:
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
        edges = H.radius_edges(df, "w", "k", "label", radius)
        assert {r.node: r.component for r in G.consistency(edges, df.withColumnRenamed("k", "node"), radius + 1).collect()} == group
        assert all(dist.get((r.a, r.b), dist.get((r.b, r.a))) == r.defect for r in edges.collect())

    d = tables("embeddings", [(1, 0, [1.0] * 64), (5, 0, [1.0] * 64), (9, 0, [-1.0] * 64)], "vec_id int, label int, embedding array<double>")
    assert {r.node: r.component for r in E.queries()["hv_clusters_all"](spark, d).collect()} == {1: 1, 5: 1, 9: 9}
    assert E.queries()["hv_baseline_all"](spark, d).select("median", "sample_size", "mad").first() == (64, 3, 0)


def test_long_observations_are_paired_too(spark):
    rows = [("x", [f"t{i:03}" for i in range(300)]), ("y", ["t001", "t000", "t001"]), ("y", ["t000"]), ("z", None)]
    got = {(r.a, r.b): (r.n, r.n_sources) for r in O.cooccurrence(spark.createDataFrame(rows, "source string, m array<string>"), "source", "m").collect()}
    assert len(got) == 300 * 299 // 2 and got[("t000", "t001")] == (2, 2) and got[("t005", "t299")] == (1, 1) and all(a < b for a, b in got)
