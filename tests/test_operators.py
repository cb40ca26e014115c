"""Operators that SQL can't state, against plain versions; and edge cases of the rest."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import patterns as P
from lodestrata.operators import chunks as C
from lodestrata.operators import extraction as X
from lodestrata.operators import facts as A
from lodestrata.operators import graphs as G
from lodestrata.operators import hypervectors as H
from lodestrata.operators import observations as O
from lodestrata.operators import versions as V
from lodestrata.operators import vectors as K


def slow_boundaries(data):
    gear, out, start = [int(x) for x in C.gear_table()], [], 0
    while start < len(data):
        end, h = min(len(data), start + C.MAX_CHUNK), 0
        if len(data) - start > C.MIN_CHUNK:
            for i in range(start + C.MIN_CHUNK, end):
                h = (2 * h + gear[data[i]]) & (2**64 - 1)
                if not h >> 48:
                    end = i + 1
                    break
        else:
            end = len(data)
        out.append((start, end - start))
        start = end
    return out


@pytest.mark.parametrize("n", [0, 1, 8191, 8192, 8193, 20_000, 400_000])
def test_chunk_boundaries_equal_the_byte_loop(n):
    data = random.Random(n).randbytes(n)
    got = C.boundaries(data)
    assert got == slow_boundaries(data)
    assert b"".join(data[o : o + k] for o, k in got) == data


def test_chunk_round_trip_and_edit_locality(spark):
    rng = random.Random(1)
    data = rng.randbytes(600_000)
    edited = data[:1000] + b"inserted" + data[1000:]
    files = spark.createDataFrame([("a", bytearray(data), 1), ("b", bytearray(edited), 2), ("e", bytearray(b""), 3), ("n", None, 4)], "id string, content binary, seq int")
    ch = C.chunk(files).persist()
    store = C.store(ch)
    assert store.count() < ch.count()
    whole = {r.node_id: r for r in C.reconstruct(ch.withColumnRenamed("id", "node_id"), store).collect()}
    assert whole["a"].complete and whole["a"].content_sha == hashlib.sha256(data).hexdigest()
    assert whole["b"].complete and whole["b"].content_sha == hashlib.sha256(edited).hexdigest()
    assert set(whole) == {"a", "b"}
    assert C.verify_blobs(store).count() == 0


def test_merkle_roots_equal_a_plain_loop(spark):
    rows = [(g, i, bytearray(hashlib.sha256(f"{g}{i}".encode()).digest())) for g, n in (("a", 1), ("b", 7), ("c", 21)) for i in range(n)]
    got = {r.g: bytes(r.root) for r in C.merkle_roots(spark.createDataFrame(rows, "g string, p int, d binary"), "g", "p", "d", fan=4).collect()}
    for g in "abc":
        level = [bytes(d) for x, _, d in rows if x == g]
        while len(level) > 1:
            nxt = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
            level = nxt + level[len(nxt) * 2 :]
        assert got[g] == level[0]


def test_hypervector_functions(spark):
    a, b = H.expand_seed(0x42), H.expand_seed(0x99)
    assert a.tobytes() == H.expand_seed(0x42).tobytes() and 3500 < int(np.bitwise_count(a ^ b).sum()) < 4700
    big = int.from_bytes(a.tobytes(), "little")
    for n in (0, 1, 63, 64, 8191):
        m = (1 << 8192) - 1
        assert int.from_bytes(H.rotate_bits(a, n).tobytes(), "little") == ((big << n) | (big >> (8192 - n))) & m if n else big
    assert (H.rotate_bits(H.rotate_bits(a, 77), -77) == a).all()
    rows = [(1, bytearray(a.tobytes())), (1, bytearray(b.tobytes())), (1, bytearray(H.expand_seed(7).tobytes()))]
    df = spark.createDataFrame(rows, "g int, hv binary")
    w = df.select("g", H.words_of(F.col("hv")).alias("hv"))
    H.register(spark)
    df.createOrReplaceTempView("hvs")
    one = spark.sql("SELECT bundle(hv) AS x, bundle_majority(hv) AS m FROM hvs").first()
    assert np.array(H.bundle(w, ["g"], "hv").first().hv, dtype="<i8").tobytes() == bytes(one.x)
    assert np.array(H.bundle_majority(w, ["g"], "hv").first().hv, dtype="<i8").tobytes() == bytes(one.m)
    assert spark.sql("SELECT popcount_xor(X'FF00', X'0F01') AS d").first().d == 5
    with pytest.raises(Exception):
        spark.createDataFrame([([1], [1, 2])], "a array<bigint>, b array<bigint>").select(H.popcount_xor(F.col("a"), F.col("b"))).collect()


def test_calibration_repeats_the_draw(spark):
    rng = random.Random(2)
    rows = [(i, [rng.getrandbits(63)]) for i in range(20)]
    got = H.calibrate(spark.createDataFrame(rows, "k int, w array<bigint>"), "w", "k", sample=50, seed=9).first()
    s, ds = 9, []
    while len(ds) < 50:
        s, x = H.splitmix64(s)
        s, y = H.splitmix64(s)
        if x % 20 != y % 20:
            ds.append((rows[x % 20][1][0] ^ rows[y % 20][1][0]).bit_count())
    med = sorted(ds)[24]
    assert (got["median"], got["mad"], got["sample_size"]) == (med, sorted(abs(d - med) for d in ds)[24], 50)
    assert H.calibrate(spark.createDataFrame(rows[:1], "k int, w array<bigint>"), "w", "k") is None


def test_knn_is_exact_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id int, embedding array<double>")
    monkeypatch.setattr(K, "BLOCK_BYTES", 8 * 8 * 10)
    got = {(r.query, r["rank"]): r.neighbour for r in K.knn(df, df, 3).collect()}
    d = ((m[:, None] - m[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for q in range(60):
        assert [got[(q, k)] for k in (1, 2, 3)] == list(np.argsort(d[q], kind="stable")[:3])
    assert K.knn(df.limit(0), df, 3).count() == 0


def test_patterns():
    import re

    ok = lambda p, s: bool(re.search(P.glob_regex(p), s))
    assert ok("a*c", "abbc") and not ok("a*c", "Abc") and ok("a?[b-d]", "axc") and not ok("a[^x]", "ax") and ok("a[", "a[")
    tm = lambda p, s: bool(re.search(P.topic_regex(p), s))
    assert tm("a.*.c", "a.b.c") and not tm("a.*.c", "a.b.b.c") and tm("a.**", "a") and tm("a.**", "a.b.c") and tm("**.c", "c") and tm("**.c", "a.b.c") and tm("a.**.z", "a.z") and tm("**", "") and not tm("a.*", "a")


def test_mentions_keep_order(spark):
    text = "see (rs/x/lib.rs:sym:Cell), `bead:ab-1` and commit:12f; src/a.go, src/a.go README.md /abs/x.rs sym:Foo. T10/lattice"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(O.mentions(F.col("t"))).collect()
    assert got[0][0] == ["rs/x/lib.rs:sym:Cell", "bead:ab-1", "commit:12f", "src/a.go", "sym:Foo"] and got[1][0] is None and got[2][0] == []


def test_agreement_refuses_other_lengths(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "s string, v array<double>")
    with pytest.raises(Exception):
        O.agreement(df, "s", "v")[0].collect()


def test_components_and_sections(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 7), (10, 11), (None, 5)] + [(100, i) for i in range(101, 140)], "a int, b int")
    got = {r.node: r.component for r in G.components(e).collect()}
    assert got[3] == 1 and got[7] == 7 and got[11] == 10 and got[139] == 100 and got[5] == 5
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "node int")
    assert G.h0_dimension(e.filter("a <= 3"), n, 2) == 4
    assert G.triangles(e).collect() == [(1, 2, 3)]
    d = G.coboundary(spark.createDataFrame([(0, 1)], "a int, b int"), spark.createDataFrame([(0, [3.0, 99.0]), (1, [5.0, 88.0])], "node int, stalk array<double>"), restriction=lambda x: F.slice(x, 1, 1))
    assert G.defects(d).first().defect == 4.0


def test_extraction_pins_rows():
    py = {(w, k, q) for w, k, q, _ in X.facts_of("import os.path as p\nfrom a import b\nclass C:\n  def m(self):\n    return p.join(b(1))\n", "python")}
    assert py == {("import", "p", "os.path"), ("import", "b", "a.b"), ("def", "C", None), ("def", "C.m", "C"), ("def", "m", "C"), ("ref", "p.join", "p"), ("ref", "join", "p"), ("ref", "b", None)}
    go = {(w, k) for w, k, _, _ in X.facts_of('package m\nimport "fmt"\nfunc Greet() { fmt.Println(add(1)) }\n// fake()\n', "go")}
    assert go == {("import", "fmt"), ("def", "Greet"), ("ref", "fmt.Println"), ("ref", "Println"), ("ref", "add")}


def test_fold_equals_recursion(spark):
    rows = [("f/p", "program", 0), ("f/p/a", "call", 5), ("f/p/b", "call", 1), ("f/p/b/x", "id", 2), ("f/p/c", "comment", 3), ("g/p", "program", 0)]
    got = {r.node_id: r for r in X.fold_hashes(spark.createDataFrame(rows, "node_id string, node_kind string, start_byte long")).collect()}

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    x = sha("0id")
    b, a = sha("1call" + x), sha("0call")
    assert got["f/p"].subtree_hash == sha("1program" + b + a) and got["f/p"].n_nodes == 4 and "f/p/c" not in got and got["g/p"].subtree_hash == sha("0program")


def test_snapshots_overlays_splices(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    root = f"file://{tmp_path}/snap"
    V.snapshot({"t": df}, root, 1)
    digest = V.snapshot({"t": df.filter("v > 1")}, root, 2)
    assert len(digest) == 64 and V.load_snapshot(spark, root, "t").count() == 2 and V.load_snapshot(spark, root, "t", 1).count() == 3
    shadow = spark.createDataFrame([("a", 9, 0), ("b", 0, 1), ("d", 4, 0)], "id string, v int, tombstone int")
    assert sorted(map(tuple, V.overlay(df, shadow, "id").collect())) == [("a", 9), ("c", 3), ("d", 4)]
    n = spark.createDataFrame([("x/y", "x", "y"), ("x/y/z", "x/y", "z"), ("x/yy", "x", "yy")], "id string, parent_id string, name string")
    assert sorted(map(tuple, V.rename_subtree(n, "x/y", "q").collect())) == [("q", "x", "q"), ("q/z", "q", "z"), ("x/yy", "x", "yy")]
    assert V.remove_subtree(n, "x/y").count() == 1
    assert V.splice(b"hello world", [(0, 5, b"bye"), (6, 11, b"all")]) == b"bye all"
    with pytest.raises(ValueError):
        V.splice(b"hello", [(0, 3, b""), (2, 4, b"")])


def test_query_surface_reads_only(spark):
    df, more = A.select_query(spark, "SELECT id FROM range(10)", 4)
    assert df.count() == 4 and more
    with pytest.raises(ValueError):
        A.select_query(spark, "DROP TABLE x")


def test_guards_and_orphan_directories(spark):
    f = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x\0y")), ("n", None), ("e", bytearray(b"")), ("p", bytearray(b"\x10\x02"))], "id string, content binary")
    assert sorted(r.id for r in A.readable(f).collect()) == ["a", "e", "p"]
    n = spark.createDataFrame([("d", 1), ("d/e", 1), ("k", 1), ("k/f", 0)], "id string, kind int")
    assert sorted(r.id for r in A.orphan_directories(n).collect()) == ["d", "d/e"]


def test_walk_and_manifests(spark, tmp_path):
    from lodestrata.sources import files as S

    for p, t in {"a.go": "package a", "node_modules/x.js": "1", ".git/c": "x", "sub/b.py": "1", "sub/skip.log": "x", "Cargo.toml": '[package]\nname="q"\nversion="1.0"\n[dependencies]\nserde="1"\n', ".gitignore": "*.log\n"}.items():
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_text(t)
    df = S.walk(spark, str(tmp_path))
    assert sorted(r.id for r in df.select("id").collect()) == ["Cargo.toml", "a.go", "sub/b.py"]
    assert {tuple(r) for r in S.manifests(df).select("kind", "name", "version").collect()} == {("package", "q", "1.0"), ("dependency", "serde", "1")}
    idx = df.select(F.col("id").alias("path"), F.col("mtime_ns").alias("mtime"), "size").filter("path != 'a.go'").unionByName(spark.createDataFrame([("old", 1, 1)], "path string, mtime long, size long"))
    assert {(r.path, r.state) for r in S.changed_files(df, idx).collect()} == {("a.go", "new"), ("old", "deleted")}


def test_tree_encoding_equals_recursion(spark):
    from lodestrata.operators import encoding as N

    rows = [("f/p", "f", "program", 0), ("f/p/a", "f", "call", 9), ("f/p/b", "f", "call", 3), ("f/p/b/x", "f", "id", 4), ("f/p/b/y", "f", "id", 6), ("g/p", "g", "program", 0), ("g/p", "g", "program", 0)]
    kids = {"f/p": ["f/p/b", "f/p/a"], "f/p/b": ["f/p/b/x", "f/p/b/y"]}
    kind = {r[0]: r[2] for r in rows}

    def hv(n):
        v = H.expand_seed(N.seed_of(kind[n], len(kids.get(n, []))))
        for i, c in enumerate(kids.get(n, [])):
            v = v ^ H.rotate_bits(hv(c), i + 1)
        return v

    got = {r.source_id: np.array(r.hv, dtype="<i8").tobytes() for r in N.encode_trees(spark.createDataFrame(rows, "node_id string, source_id string, node_kind string, start_byte long")).collect()}
    assert got == {"f": hv("f/p").tobytes(), "g": hv("g/p").tobytes()}


def test_indexes_and_proofs(spark):
    from lodestrata.operators import surface as U

    v = U.VectorIndex(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "node_id string, embedding array<double>"), 2)
    v.upsert(spark.createDataFrame([("a", [0.0, 2.0]), ("c", [5.0, 5.0])], "node_id string, embedding array<double>"))
    assert len(v) == 3 and v.get("a").first().embedding == [0.0, 2.0]
    q = spark.createDataFrame([("q", [0.0, 1.9])], "node_id string, embedding array<double>")
    assert [r.neighbour for r in v.search(q, 2).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        U.VectorIndex(q, 3).df.collect()
    t = U.TextIndex(spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None)], "doc_id int, text string"))
    assert [r.item for r in t.search("RED").orderBy("rank").collect()] == [2, 1] and t.search("").count() == 0 and t.search("red", 0).count() == 0
    assert len(t.remove(spark.createDataFrame([(2,)], "doc_id int")).upsert(spark.createDataFrame([(1, "x"), (9, "y")], "doc_id int, text string"))) == 3
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(7)]
    level = leaves
    while len(level) > 1:
        nxt = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = nxt + level[len(nxt) * 2 :]
    for i, leaf in enumerate(leaves):
        assert U.merkle_verify(leaf, U.merkle_proof(leaves, i), level[0]) and not U.merkle_verify(b"x" * 32, U.merkle_proof(leaves, i), level[0])
