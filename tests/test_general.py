"""Orphan references, per-key results under skew, hierarchies: edge cases and brute force."""

import random
from collections import Counter
from datetime import datetime as D

import pytest

from lodestrata.operators import hierarchy as H
from lodestrata.operators import integrity as I
from lodestrata.operators import skew as S

T1, T2, T3 = D(2025, 1, 1), D(2025, 2, 1), D(2025, 3, 1)


# ---------------------------------------------------------------- p3


def orphans(spark, refs, targets, deletions, **kw):
    r = spark.createDataFrame(refs, "source_id string, node_id string, ingested_at timestamp, fk string, born string")
    t = spark.createDataFrame(targets, "node_id string, ingested_at timestamp, pk string")
    d = spark.createDataFrame(deletions, "del_table string, del_key string, deleted_at timestamp")
    ref = I.Reference("node_refs", "source_id", "node_id", "ast_nodes", "node_id")
    return sorted((x.ref_key or "", x.target_key, x.n_rows) for x in I.orphan_references(r, ref, t, d, **kw).collect())


def test_orphans_missing_deleted_later_and_clashing_columns(spark):
    refs = [("f1", "gone", T2, "x", "y"), ("f2", "dead", T2, "", ""), ("f3", "young", T1, "", ""), ("f4", "young", T3, "", ""), ("f5", None, T1, "", ""), ("f6", "ok", T2, "", ""), ("f6", "ok", T2, "", ""), ("f7", "back", T3, "", ""), (None, "gone", T1, "", "")]
    targets = [("dead", T1, "p"), ("young", T2, "p"), ("ok", T1, "p"), ("ok", T1, "p"), ("back", T1, "p"), ("back", T3, "p"), (None, T1, "p")]
    dels = [("ast_nodes", "dead", T2), ("ast_nodes", "back", T2), ("source_files", "ok", T3), ("ast_nodes", None, T3), ("ast_nodes", "ok", None)]
    assert orphans(spark, refs, targets, dels) == [("", "gone", 1), ("f1", "gone", 1), ("f2", "dead", 1), ("f3", "young", 1)]


def test_orphans_deletion_at_the_last_ingestion_counts_and_rows_are_counted(spark):
    refs = [("f", "k", T3, "", "")] * 3 + [("f", "k", T1, "", "")]
    assert orphans(spark, refs, [("k", T2, "")], [("ast_nodes", "k", T2)]) == [("f", "k", 1), ("f", "k", 3)]


def test_orphans_empty_tables(spark):
    assert orphans(spark, [], [], []) == []
    assert orphans(spark, [("f", "k", T1, "", "")], [], []) == [("f", "k", 1)]


def test_orphans_null_times(spark):
    assert orphans(spark, [("f", "k", None, "", "")], [("k", T2, "")], []) == []
    assert orphans(spark, [("f", "k", T1, "", "")], [("k", None, "")], []) == []


def test_orphans_hot_keys_and_brute_force(spark):
    rng = random.Random(3)
    times = [T1, T2, T3]
    keys = [f"k{i}" for i in range(30)]
    refs = [(f"f{rng.randrange(40)}", rng.choice(["hot"] * 20 + keys), rng.choice(times), "", "") for _ in range(1500)]
    targets = [(k, rng.choice(times), "") for k in keys[:20] for _ in range(rng.randrange(1, 3))]
    dels = [("ast_nodes", rng.choice(keys), rng.choice(times)) for _ in range(8)]
    born, last, gone = {}, {}, {}
    for k, t, _ in targets:
        born[k], last[k] = min(t, born.get(k, t)), max(t, last.get(k, t))
    for _, k, t in dels:
        gone[k] = max(t, gone.get(k, t))
    want = Counter()
    for s, k, t, *_ in refs:
        if k not in born or (k in gone and gone[k] >= last[k]) or born[k] > t:
            want[(s, k)] += 1
    got = Counter()
    for s, k, n in orphans(spark, refs, targets, dels, share=0.05, salts=4):
        got[(s, k)] += n
    assert got == want


# ---------------------------------------------------------------- p4


def test_profile_counts_exactly(spark):
    rows = [("a", "n1", "f1"), ("a", "n1", "f1"), ("a", "n2", None), ("", None, "f1"), (None, "n1", "f2")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "token string, node string, file string, what int, value int, _key int")
    got = {r.token: (r.rows, r.n_n, r.n_f) for r in S.per_key_profile(df, "token", {"n": "node", "f": "file"}).collect()}
    assert got == {"a": (3, 2, 1), "": (1, 0, 1), None: (1, 1, 1)}
    assert S.per_key_profile(df.limit(0), "token", {"n": "node"}).count() == 0


def test_mode_takes_the_smallest_among_equals(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", None)], "k string, v string")
    assert [(r.k, r.mode, r.mode_rows) for r in S.per_key_mode(df, "k", "v").collect()] == [("a", "x", 1)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_is_exact(spark, q):
    import math

    rng = random.Random(int(q * 100))
    rows = [(rng.choice("aaaab"), float(rng.choice([rng.randrange(5), rng.randrange(10**6)]))) for _ in range(800)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.percentile for r in S.per_key_percentile(df, "k", "v", q).collect()}
    for k in "abc":
        vs = sorted(v for a, v in rows if a == k)
        assert got[k] == vs[max(1, math.ceil(len(vs) * q)) - 1]
    assert "d" not in got


def test_salted_join_is_an_inner_join(spark):
    big = spark.createDataFrame([("h" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, 0)], "k string, i int")
    keyed = spark.createDataFrame([("h", 1), ("k0", 2), ("k5", 3), (None, 4)], "k string, v int")
    heavy = spark.createDataFrame([("h",)], "k string")
    got = sorted((r.k, r.i, r.v) for r in S.salted_join(big, keyed, "k", heavy, 5, "i").collect())
    assert got == sorted((r.k, r.i, r.v) for r in big.join(keyed, "k").collect())


# ---------------------------------------------------------------- p6


def tree(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, parent_id string, name string, mtime long, depth int, root_id string")
    return {r.id: r for r in H.hierarchy(df, **kw).collect()}


def test_hierarchy_paths_cycles_and_dirt(spark):
    rows = [("r", None, "root", 1), ("a", "r", "a", 1), ("a", "r", "a", 1), ("b", "a", "old", 1), ("b", "r", "b", 2), ("e", "", "e", 1), ("o", "nowhere", None, 1), ("c1", "c2", "c1", 1), ("c2", "c3", "c2", 1), ("c3", "c1", "c3", 1), ("t", "c2", "t", 1), ("s", "s", "s", 1), (None, "r", "n", 1), ("n", "a", "n", None)]
    t = tree(spark, rows, ancestors=True)
    assert {k: (v.root_id, v.depth, v.path) for k, v in t.items()} == {
        "r": ("r", 0, "root"), "a": ("r", 1, "root/a"), "b": ("r", 1, "root/b"), "n": ("r", 2, "root/a/n"), "e": ("e", 0, "e"), "o": ("o", 0, ""),
        "c1": ("c1", -1, None), "c2": ("c1", -1, None), "c3": ("c1", -1, None), "t": ("c1", -1, None), "s": ("s", -1, None),
    }
    assert t["n"].ancestors == ["r", "a"] and t["s"].ancestors is None


def test_hierarchy_empty(spark):
    assert tree(spark, []) == {}


def test_hierarchy_deep_and_wide_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("p000", None, "p", 1)] + [(f"p{i:03}", f"p{i - 1:03}", f"n{i}", 1) for i in range(1, 70)] + [(f"w{i}", "p002", f"w{i}", 1) for i in range(80)]
    rows += [(f"q{i}", f"q{rng.randrange(60)}", f"q{i}", 1) for i in range(60)]
    by = {r[0]: r for r in rows}
    got = tree(spark, rows, ancestors=True, levels_per_step=2, wide_steps=2)
    for i in by:
        path, cur = [i], i
        while True:
            p = by[cur][1]
            if not p or p not in by:
                want = (cur, len(path) - 1, "/".join(by[x][2] for x in reversed(path)), list(reversed(path[1:])))
                break
            if p in path:
                want = (min(path[path.index(p) :]), -1, None, None)
                break
            path.append(p)
            cur = p
        assert (got[i].root_id, got[i].depth, got[i].path, got[i].ancestors) == want, i


def test_descendants(spark):
    df = spark.createDataFrame([("r", None, "r", 1), ("a", "r", "a", 1), ("b", "a", "b", 1), ("x", "y", "x", 1), ("y", "x", "y", 1)], "id string, parent_id string, name string, mtime long")
    assert sorted(map(tuple, H.descendants(df).select("id", "descendant_id", "distance").collect())) == [("a", "b", 1), ("r", "a", 1), ("r", "b", 2)]
