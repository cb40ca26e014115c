"""Syntax rows, sections, random projections, incremental chunking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunks as C
from lodestrata.operators import projection as P


def test_rows_of_a_python_text():
    text = "﻿import os\n\nclass A(B):\n    def f(self, é='ü'):\n        return g(h(1), k)\n\n    def f2(self): pass\nasync def z(): pass\n".encode()
    rows = {r[0]: r for r in P.python_nodes("r/a.py", text)}
    assert list(rows) == ["r/a.py", "r/a.py/import_statement_0", "r/a.py/class_definition_0", "r/a.py/function_definition_0"] + list(rows)[4:]
    f = rows["r/a.py/class_definition_0/function_definition_0"]
    assert f[3] == "f" and f[4] == "r/a.py/class_definition_0" and text[f[5] : f[6]].decode().startswith("def f(self") and f[7:] == (3, 4, 4, 25)
    g = rows["r/a.py/class_definition_0/function_definition_0/call_0"]
    assert text[g[5] : g[6]] == b"g(h(1), k)" and text[slice(*rows[g[0] + "/call_0"][5:7])] == b"h(1)" and rows[g[0] + "/call_0"][4] == f[0]
    assert "r/a.py/class_definition_0/function_definition_1" in rows
    assert P.python_nodes("x", b"def f(:") == [] and len(P.python_nodes("x", b"")) == 1
    assert len(P.python_nodes("x", b"x = " + b"f(" * 60 + b")" * 60)) == 61


def test_projection_of_dirty_tables(spark):
    rows = [("r/a.py", b"def f(): pass\n", 1), ("r/a.py", b"def f(): pass\n", 2), ("r/b.go", b"package a", 1), ("r/c.py", None, 1), (None, b"x", 1), ("r/d.py", b"(", 1)]
    d = spark.createDataFrame([(i, None if c is None else bytearray(c), n) for i, c, n in rows], "id string, content binary, start_row int")
    assert {(r.node_id, r.node_kind) for r in P.project_python(d).collect()} == {("r/a.py", "module"), ("r/a.py/function_definition_0", "function_definition")}
    assert P.project_python(d).count() == 2 and P.project_python(d.limit(0)).count() == 0


def test_simhash_keeps_angles(spark):
    planes = P.hyperplanes("layer", 6, 512)
    assert planes.shape == (512, 6) and np.array_equal(planes, P.hyperplanes("layer", 6, 512)) and abs(planes.mean()) < 0.1 and abs(planes.std() - 1) < 0.1
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 6))
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(98, None), (99, [1.0])], "k int, v array<double>")
    got = {r.k: r.hv for r in P.simhash(d, "v", planes).collect()}
    assert got[98] is None and got[99] is None
    bits = np.array([np.unpackbits(np.array(got[i], dtype="<i8").view(np.uint8), bitorder="little") for i in range(40)])
    assert np.array_equal(bits.astype(bool), v @ planes.T >= 0)
    angle = np.arccos(np.clip((v @ v.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1), -1, 1)) / np.pi
    assert np.abs((bits[:, None] ^ bits[None]).mean(axis=2) - angle).max() < 0.12


def test_rechunk_equals_cutting_the_whole():
    rng = random.Random(4)
    base = bytes(rng.randrange(256) for _ in range(400_000))
    old = C.boundaries(base)
    for _ in range(12):
        at, removed = rng.randrange(len(base) + 1), rng.choice([0, 1, 500, 40_000])
        removed = min(removed, len(base) - at)
        new = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 700, 30_000])))
        data = base[:at] + new + base[at + removed :]
        got, stats = P.rechunk(old, data, at, removed, len(new))
        assert got == C.boundaries(data) and stats["kept"] + stats["cut"] == len(got)
    middle = base[:200_000] + b"x" + base[200_001:]
    assert P.rechunk(old, middle, 200_000, 1, 1)[1]["cut"] <= 3 and len(old) > 4
    assert P.rechunk([], b"", 0, 0, 0)[0] == [] and P.rechunk([], b"abc", 0, 0, 3)[0] == [(0, 3)]


def test_sections(spark):
    defs = spark.createDataFrame([("f", "s/f", "s"), ("g", "t/g", "t"), ("h", "t/h", "t")], "token string, node_id string, source_id string")
    refs = spark.createDataFrame([("f", "t/g/1", "t", "t/g"), ("g", "s/f/1", "s", "s/f"), ("f", "x", "t", None)], "token string, node_id string, source_id string, container_node_id string")
    nodes = spark.createDataFrame([("s/f", "s", "function_item", "2024-01-02")], "node_id string, source_id string, node_kind string, t string").withColumn("ingested_at", F.to_timestamp("t"))
    for c in ("start_row", "start_col", "end_row", "end_col", "start_byte", "end_byte"):
        nodes = nodes.withColumn(c, F.lit(0))
    symbols = spark.createDataFrame([("s/f", "fn f()"), ("s/f", " "), ("t/g", "fn g()")], "node_id string, detail string")
    got = {(r.section, r.node_id, r.source_id, r.text) for r in P.symbol_sections("f", defs, refs, nodes, symbols).collect()}
    assert got == {("definitions", "s/f", "s", "function"), ("callers", "t/g", "t", None), ("callees", "t/g", "t", "g"), ("hover", "s/f", None, "fn f()"), ("freshness", "s/f", None, "2024-01-02 00:00:00")}
    assert {r.section for r in P.symbol_sections("f", defs, refs, nodes, symbols, ("HOVER",)).collect()} == {"hover"}
    with pytest.raises(ValueError):
        P.symbol_sections("f", defs, refs, nodes, symbols, ("none",))
