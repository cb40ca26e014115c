"""Cell complexes, resolution, positions, chunk states, storage."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import kinds as K
from lodestrata.operators import cells as C
from lodestrata.operators import resolution as R
from lodestrata.operators import skew as S
from lodestrata.session import Workspace, shared_dir


def test_restriction_maps():
    assert C.project_dim(3, 1) == [[0, 1, 0]] and C.identity(2) == [[1, 0], [0, 1]] and C.weighted(3, {2: 0.5}) == [[0, 0, 0.5]]
    assert C.compose(C.weighted(2, {0: 2, 1: 1}), C.project_range(3, 2)) == [[2, 1, 0]]
    with pytest.raises(ValueError):
        C.project_range(2, 3)
    with pytest.raises(ValueError):
        C.compose(C.identity(3), C.identity(2))


def brute_cycles(edges, longest):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    out = set()
    for n in range(3, longest + 1):
        for p in itertools.permutations(adj, n):
            if p[0] == min(p) and p[1] < p[-1] and all(y in adj[x] for x, y in zip(p, p[1:] + p[:1])):
                out.add(p)
    return out


def test_cycles_faces_and_cohomology(spark):
    rng = random.Random(3)
    edges = [(1, 2), (2, 1), (2, 3), (1, 3), (3, 4), (4, 5), (5, 1), (4, 4), (6, 7), (None, 3)] + [(rng.randrange(1, 8), rng.randrange(1, 8)) for _ in range(4)]
    e = spark.createDataFrame([(a, b, "x") for a, b in edges], "a int, b int, face string").select("a", "b", "face")
    plain = {(min(a, b), max(a, b)) for a, b in edges if a and b and a != b}
    assert {tuple(r.cycle) for r in C.cycles(e, 6).collect()} == brute_cycles(plain, 6)
    with pytest.raises(ValueError):
        C.cycles(e, 9)
    stalks = spark.createDataFrame([(i, [float(i * i), 1.0 / i]) for i in range(1, 8)], "node int, stalk array<double>")
    whole = e.filter("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    signed = C.signed_faces(C.cycles(e, 5))
    assert C.cochain_faults(whole, signed, stalks, C.identity(2)).count() == 0
    assert C.cochain_faults(whole, signed.withColumn("sign", F.lit(1.0)), stalks, C.identity(2)).count() > 0
    square = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (1, 3), (5, 6), (6, 7), (5, 7)], "a int, b int")
    assert C.cycle_rank(square).first()["cycle_rank"] == 3
    assert C.h1_dimension(square, C.signed_faces(C.cycles(square, 3).filter("cycle[0] = 1"))) == 1
    assert C.h1_dimension(square, signed.limit(0)) == 0
    assert C.cycles(square.limit(0)).count() == 0


def test_delta_takes_edges_along(spark):
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "node string, v int")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "a string, b string")
    names = lambda *x: spark.createDataFrame([(i, 2) for i in x], "node string, v int")
    pairs = lambda *x: spark.createDataFrame(list(x), "a string, b string")
    nodes, edges = C.apply_delta(n, e, names("b", "none"), pairs(("x", "y")), names("d", "a"), pairs(("a", "d"), ("a", "d"), ("d", "b")))
    assert {(r.node, r.v) for r in nodes.collect()} == {("a", 2), ("c", 1), ("d", 2)}
    assert {(r.a, r.b) for r in edges.collect()} == {("a", "c"), ("a", "d")}


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a int, b int")
    assert {(r.a, r.b, r.via) for r in C.closure(e).collect()} == {(2, 4, 3), (1, 4, 3)}


def test_specifiers(spark):
    files = spark.createDataFrame([(i,) for i in ("r/a/store.go", "r/b/store.go", "r/x/Makefile", "r/x/qux.rs", "r/y/baz.rs", "q/store.go", "r/z/odd.txt", None)], "id string")
    specs = [("r", "go", "./x/store"), ("r", "rust", "crate::baz::Thing"), ("r", "rust", "qux"), ("r", None, "../Makefile"), ("r", "python", "a.odd"), ("r", "go", "nothing"), ("r", "go", " "), ("r", "go", None), ("q", "go", "store")]
    d = spark.createDataFrame([(*s, 1) for s in specs], "repository string, language string, spec string, id int").drop("id")
    got = {(r.spec, r.repository, r.target, r.confidence) for r in R.resolve_specifiers(d, files).collect()}
    assert got == {("./x/store", "r", "r/a/store.go", 0.85), ("./x/store", "r", "r/b/store.go", 0.85), ("crate::baz::Thing", "r", "r/y/baz.rs", 0.7), ("qux", "r", "r/x/qux.rs", 0.85), ("../Makefile", "r", "r/x/Makefile", 0.8), ("a.odd", "r", "r/z/odd.txt", 0.5), ("store", "q", "q/store.go", 0.85)}


def test_imports_by_token_or_qualifier(spark):
    refs = spark.createDataFrame([("f", "Do", "x"), ("f", "Go", None), ("f", "y", "z"), ("g", "Do", "x"), ("f", "Do", "x")], "source_id string, token string, qualifier string")
    imports = spark.createDataFrame([("f", "x", "late/x", 9), ("f", "x", "first/x", 2), ("f", "y", "p/y", 5), ("f", "z", "p/z", 4), ("f", None, "n", 1)], "source_id string, token string, qualifier string, row long")
    defs = spark.createDataFrame([("Do", "n1", "s"), ("Do", "n2", "s"), ("Do", "n1", "s")], "token string, node_id string, source_id string")
    got = {(r.source_id, r.token, r.qualifier): (r.via_import, r.n_candidates) for r in R.resolve_imports(refs, imports, defs).collect()}
    assert got == {("f", "Do", "x"): ("first/x", 2), ("f", "Go", None): (None, 0), ("f", "y", "z"): ("p/z", 0), ("g", "Do", "x"): (None, 2)}


def test_text_at_ranges(spark):
    text = "ab.cd(é)\nsecond line\nthird"
    cases = [(0, 3, 0, 5, "cd", "ab"), (0, 6, 0, 7, "é", None), (0, 0, 0, 2, "ab", None), (0, 7, 1, 6, ")\nsecond", None), (0, 3, 2, 2, "cd(é)\nsecond line\nth", "ab"), (0, 3, 0, 99, None, "ab"), (9, 0, 9, 1, None, None), (1, 3, 0, 1, None, None)]
    d = spark.createDataFrame([(text, *c) for c in cases], "text string, a int, b int, c int, d int, token string, qualifier string")
    for r in d.select("token", "qualifier", R.token_at(F.col("text"), F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("t"), R.qualifier_at(F.col("text"), F.col("a"), F.col("b")).alias("q")).collect():
        assert (r.t, r.q) == (r.token, r.qualifier)


def test_queue_policies_and_decay(spark):
    q = spark.createDataFrame([("a", 1), ("b", 5), ("a", 9), ("c", 5), ("d", 0)], "node_id string, priority int")
    assert [(r.node_id, r.priority) for r in R.drain(q, 3).collect()] == [("a", 9), ("c", 5), ("b", 5)]
    p = spark.createDataFrame([("x", True, True), ("x", True, False), ("x", False, True), ("y", False, False)], "policy string, skips boolean, changed boolean")
    assert {(r.policy, r.false_skips, r.sound_skips) for r in R.policy_stats(p).collect()} == {("x", 1, 1), ("y", 0, 0)}
    t = spark.createDataFrame([("a", "b", 0), ("a", "b", 90 * 86400), ("a", "c", 99 * 86400)], "a string, b string, s long").withColumn("at", F.timestamp_seconds("s"))
    now = t.agg(F.max(F.when(F.col("s") == 90 * 86400, F.col("at")))).first()[0]
    got = {(r.a, r.b): r.weight for r in R.decayed(t, "at", now).collect()}
    assert got[("a", "b")] == pytest.approx(1 + 0.36787944117, rel=1e-9) and got[("a", "c")] == 1.0


def test_chunk_lists(spark):
    t0, t1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
    files = spark.createDataFrame([("a", b"x", t0), ("a", b"y", t1), ("b", b"x", t0), ("c", None, t0), ("d", b"", t0)], "id string, content binary, t string").withColumn("ingested_at", F.to_timestamp("t"))
    man = spark.createDataFrame([("a", 0, b"1", 0, 3, t0), ("b", 0, b"1", 0, 3, t0), ("b", 1, b"2", 4, 2, t0), ("b", 2, b"9", 6, 1, t0), ("b", 3, b"3", 7, 5, t0), (None, 0, b"1", 0, 3, t0)], "node_id string, seq long, chunk_hash binary, byte_offset long, byte_len long, t string").withColumn("ingested_at", F.to_timestamp("t"))
    chunks = spark.createDataFrame([(b"1", b"abc", 3), (b"1", b"abc", 3), (b"2", b"de", 2), (b"3", b"short", 6)], "chunk_hash binary, chunk_bytes binary, chunk_len long")
    assert {(r.source_id, r.state) for r in R.manifest_freshness(files, man).collect()} == {("a", "stale"), ("b", "fresh"), ("d", "missing")}
    assert {r.source_id for r in R.activation(files, man).collect()} == {"a", "d"}
    assert {(r.node_id, r.seq): r.verdict for r in R.verified_pages(man, chunks).collect()} == {("a", 0): "ok", ("b", 0): "ok", ("b", 1): "gap", ("b", 2): "missing", ("b", 3): "length"}


def test_canonical_kinds(spark):
    want = {("rust", "impl_item"): None, ("go", "package_clause"): None, ("go", "source_file"): "module", ("rust", "function_signature_item"): "function", ("java", "record_declaration"): "type", ("cpp", "class_specifier"): "type", ("sql", "create_table"): "type", ("python", "typed_parameter"): "parameter", ("bash", "command"): None, ("javascript", "function_signature"): None, ("typescript", "function_signature"): "function"}
    d = spark.createDataFrame([(*k, v) for k, v in want.items()], "language string, kind string, want string")
    assert all(r.got == r.want for r in d.select("want", K.canonical_kind(F.col("language"), F.col("kind")).alias("got")).collect())


def test_percentiles_of_any_spread(spark):
    """Values that double, so that ranges of equal width would hold all of them in one block, under a hot and a NULL key."""
    rng = random.Random(1)
    rows = [("hot", float(2.0**i)) for i in range(900)] + [("hot", 5.0)] * 50 + [(None, float(i)) for i in range(300)] + [(k, float(rng.randrange(9))) for k in "abc" for _ in range(rng.randrange(1, 9))] + [("a", None)]
    d = spark.createDataFrame(rows, "key string, value double")
    for q in (0.0, 0.5, 0.9, 1.0):
        want = {}
        for k in {k for k, _ in rows}:
            v = sorted(x for y, x in rows if y == k and x is not None)
            want[k] = v[max(0, -(-len(v) * q // 1).__int__() - 1)]
        assert {r.key: r.percentile for r in S.per_key_percentile(d, "key", "value", q).collect()} == want
    assert S.per_key_percentile(d.limit(0), "key", "value").count() == 0


def test_workspace_drops_and_closes(spark):
    ws = Workspace(spark, "test")
    a, b, c = (ws.write(spark.range(3)) for _ in range(3))
    root = ws.root.removeprefix("file://")
    assert len(os.listdir(root)) == 3
    ws.drop(a)
    ws.keep(c)
    assert len(os.listdir(root)) == 1 and c.count() == 3
    ws.close()
    assert not os.path.exists(root)


def test_shared_folder_is_named_on_clusters():
    from types import SimpleNamespace as N

    def session(master, named=None, context=None):
        held = N(isDefined=lambda: context is not None, get=lambda: context)
        return N(conf=N(get=lambda key, default: named), sparkContext=N(master=master), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: held)))

    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[2,1,1024]"))
    assert shared_dir(session("yarn", "hdfs:/x/")) == "hdfs:/x" and shared_dir(session("yarn", None, "hdfs:/y")) == "hdfs:/y"
    assert shared_dir(session("local[4]")).startswith("file:")


def test_ignore_rules():
    import re as r

    from lodestrata.sources.files import ignore_pattern as rule

    def out(path, *lines, folder=""):
        hit = False
        for keeps, pattern in filter(None, (rule(x, folder) for x in lines)):
            if r.search(pattern, path):
                hit = not keeps
        return hit

    assert out("a/x.log", "*.log") and not out("a/x.log", "*.log", "!x.log") and not out("x.logs", "*.log")
    assert out("build/a/b", "build/") and not out("build", "build/") and out("x/build/a", "build/")
    assert out("a/b/c", "/a/*/c") and not out("a/b/b/c", "/a/*/c") and out("a/b/b/c", "a/**/c") and out("a/c", "a/**/c") and not out("z/a/c", "/a/c")
    assert out("sub/t.tmp", "*.tmp", folder="sub") and not out("t.tmp", "*.tmp", folder="sub") and not out("subs/t.tmp", "/t.tmp", folder="sub")
    assert out("a1", "a[0-9]") and not out("ax", "a[0-9]") and out("ax", "a[!0-9]") and rule("# x", "") is None and rule("  ", "") is None


def test_heads_form_a_chain(spark, tmp_path):
    from lodestrata.operators import versions as V

    root = str(tmp_path / "store")
    assert V.current(spark, root) is None and V.history(spark, root).count() == 0
    digests = [V.snapshot({"t": spark.range(n)}, root, v) for v, n in ((1, 3), (2, 5))]
    assert V.load_snapshot(spark, root, "t").count() == 5 and V.load_snapshot(spark, root, "t", 1).count() == 3
    V.revert(spark, root, 1, 3)
    V.revert(spark, root, 3, 4)
    assert V.load_snapshot(spark, root, "t").count() == 3 and V.load_snapshot(spark, root, "t", 2).count() == 5
    rows = V.history(spark, root).orderBy("position").collect()
    assert [(r.version, r.reverts_to, r.intact) for r in rows] == [(4, 1, True), (3, 1, True), (2, None, True), (1, None, True)] and rows[3].digest == digests[0]
    head = tmp_path / "store" / "heads" / "2.json"
    head.write_text(head.read_text().replace('"rows": 5', '"rows": 6'))
    for crc in (tmp_path / "store" / "heads").glob(".*.crc"):
        crc.unlink()
    assert [r.intact for r in V.history(spark, root).orderBy("position").collect()] == [True, True, False, False]
    with pytest.raises(ValueError):
        V.revert(spark, root, 9, 10)
