import json

import pytest

from lodestrata.streaming import events as E


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))


def test_session_ingest_drops_what_is_not_newer(spark, tmp_path):
    src, out, marks, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks"), str(tmp_path / "cp")
    write(src, "1.jsonl", [{"turn": 1, "role": "user", "ts_ms": 10, "text": "see src/a.rs"}, {"turn": 2, "role": "a", "ts_ms": 20, "text": "sym:X"}, "broken"])
    E.ingest(E.read_sessions(spark, str(src), True), out, marks, cp).awaitTermination(120)
    write(src, "2.jsonl", [{"turn": 3, "role": "a", "ts_ms": 20, "text": "late"}, {"turn": 4, "role": "a", "ts_ms": 30, "text": "new"}])
    E.ingest(E.read_sessions(spark, str(src), True), out, marks, cp).awaitTermination(120)
    rows = {r.ts_ms: (r.turn, r.mentions) for r in spark.read.parquet(out).collect()}
    assert rows == {10: (1, ["src/a.rs"]), 20: (2, ["sym:X"]), 30: (4, [])}


def test_replay_gap_and_ring(spark):
    log = spark.createDataFrame([(i, t, "e", s, "{}") for i, (t, s) in enumerate([("a.b", "x"), ("a.c", "y"), ("a.b.c", None), ("z", "x")], 5)], E.EVENT)
    assert [r.seq for r in E.replay(log, 4, "a.**", "x").collect()] == [6, 7]
    assert E.has_gap(log, 3) and not E.has_gap(log, 0) and not E.has_gap(log, 5)
    assert [r.seq for r in E.keep_last(log, 2).orderBy("seq").collect()] == [7, 8]


def test_windowed_counts_and_state(spark, tmp_path):
    d = tmp_path / "s"
    spark.createDataFrame([("e1", 1, 1.0), ("e1", 2, 0.0), ("e2", 1, 1.0)], "edge string, seq long, hit double").coalesce(1).write.parquet(str(d))
    q = E.co_change_rates(spark.readStream.schema("edge string, seq long, hit double").parquet(str(d))).writeStream.outputMode("update").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert {r.edge: round(r.rate, 6) for r in spark.table("rates").collect()} == {"e1": 0.09, "e2": 0.1}
    w = tmp_path / "w"
    spark.sql("SELECT timestamp'2025-01-01 00:00:10' AS ts, 'k' AS k UNION ALL SELECT timestamp'2025-01-01 00:59:00', 'k' UNION ALL SELECT timestamp'2025-01-01 05:00:00', 'k'").coalesce(1).write.parquet(str(w))
    q = E.windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(str(w)), "ts", "k", "1 hour").writeStream.outputMode("append").format("memory").queryName("wins").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("wins").collect()] == [2]


def test_schedule():
    assert E.schedule({"hdc": ("tree",), "tree": (), "lsp": ("tree",), "a": ("lsp",)}) == ["tree", "hdc", "lsp", "a"]
    with pytest.raises(ValueError):
        E.schedule({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError):
        E.schedule({"a": ("c",)})
