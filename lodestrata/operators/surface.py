"""The rest of the query surface: positions of the language server, indexes, proofs, change cascades, metadata."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.positions import node_at
from lodestrata.operators.textsearch import search
from lodestrata.operators.vectors import knn
from lodestrata.session import Workspace


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, position) of all tables; optional tables that are absent simply aren't listed."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, k, i) for t, df in sorted(tables.items()) for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for t, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that enrichment may not have written yet: empty with its schema where the path doesn't exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def at_position(facts: DataFrame, ast: DataFrame, source: str, row: int, col: int) -> DataFrame:
    """Hover, definition or reference rows (any table keyed by node_id) of the innermost node at a position."""
    return facts.join(node_at(ast, source, row, col).select("node_id"), "node_id", "left_semi")


def _replaced(index, df: DataFrame) -> DataFrame:
    """The state of an index after a change, written, so that changes don't pile up in its plan. The state
    before stays for plans that were made from it, those before that go."""
    ws = index.__dict__.setdefault("_ws", Workspace(df.sparkSession, "index"))
    new = ws.write(df)
    ws.keep(new, index.df)
    return new


class VectorIndex:
    """Vectors by key with upsert, get, search, len and clear; other dimensions raise."""

    def __init__(self, df: DataFrame, dims: int, key: str = "node_id", vector: str = "embedding"):
        self.dims, self.key, self.vector = dims, key, vector
        self.df = self._checked(df)

    def _checked(self, df: DataFrame) -> DataFrame:
        ok = F.when(F.size(self.vector) == self.dims, F.col(self.vector)).otherwise(F.raise_error(F.lit(f"vectors must have {self.dims} dimensions")).cast(df.schema[self.vector].dataType))
        return df.select(self.key, ok.alias(self.vector))

    def upsert(self, new: DataFrame) -> VectorIndex:
        fresh = self._checked(new).dropDuplicates([self.key])
        self.df = _replaced(self, self.df.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh))
        return self

    def get(self, key) -> DataFrame:
        return self.df.filter(F.col(self.key) == key)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return knn(self._checked(queries), self.df, k, self.key, self.vector, keep_self=True)

    def clear(self) -> VectorIndex:
        self.df = self.df.limit(0)
        return self

    def __len__(self) -> int:
        return self.df.count()


class TextIndex:
    """Texts by key with upsert, remove, search, len and clear; an empty query or k = 0 has no results."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text"):
        self.key, self.text, self.df = key, text, df.select(key, text)

    def upsert(self, new: DataFrame) -> TextIndex:
        fresh = new.select(self.key, self.text).dropDuplicates([self.key])
        self.df = _replaced(self, self.df.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh))
        return self

    def remove(self, keys: DataFrame) -> TextIndex:
        self.df = self.df.join(keys.select(self.key).distinct(), self.key, "left_anti")
        return self

    def search(self, query: str, k: int = 10) -> DataFrame:
        q = self.df.sparkSession.createDataFrame([("q", query)], "query string, q_text string")
        return search(self.df, q, k, self.key, self.text).select("item", "score", "rank")

    def clear(self) -> TextIndex:
        self.df = self.df.limit(0)
        return self

    def __len__(self) -> int:
        return self.df.count()


def chat_records(results: DataFrame) -> DataFrame:
    """Fields of chat records kept as JSON text: title, project, month, transcript."""
    return results.select("id", *[F.get_json_object("record", f"$.item.{c}").alias(c) for c in ("title", "project", "year_month", "transcript")])


def merkle_proof(level: list[bytes], index: int) -> list[tuple[str, bytes]]:
    """Siblings (side, digest) on the way from a leaf to the root of the pairwise tree with odd ones promoted."""
    out, i = [], index
    while len(level) > 1:
        if i ^ 1 < len(level):
            out.append(("left" if i & 1 else "right", level[i ^ 1]))
        nxt = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level, i = nxt + level[len(nxt) * 2 :], i // 2
    return out


def merkle_verify(leaf: bytes, proof: list[tuple[str, bytes]], root: bytes) -> bool:
    for side, d in proof:
        leaf = hashlib.sha256(b"\1" + (d + leaf if side == "left" else leaf + d)).digest()
    return leaf == root


def cascade(edges: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """(region, depth): regions that a change reaches over edges whose boundary moved.

    edges: a, b, boundary, baseline (hashes of what the edge carries now and when it was last agreed on). The change passes
    an edge only where the two differ; a region is marked when it is first reached, whether the change goes on from it or
    not, and at most max_depth steps are made.
    """
    ws = Workspace(edges.sparkSession, "cascade")
    both = edges.select("a", "b", (F.col("boundary") != F.col("baseline")).alias("moved")).filter("moved")
    both = both.select(F.col("a").alias("f"), F.col("b").alias("t")).unionByName(both.select(F.col("b").alias("f"), F.col("a").alias("t"))).distinct()
    front = ws.write(changed.select("region").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for d in range(1, max_depth + 1):
        nxt = ws.write(both.join(front.select(F.col("region").alias("f")), "f", "left_semi").select(F.col("t").alias("region")).distinct().join(seen.select("region"), "region", "left_anti").withColumn("depth", F.lit(d)))
        if not nxt.limit(1).count():
            break
        seen, front = seen.unionByName(nxt), nxt
    return seen


def cache_defect(edges: DataFrame) -> DataFrame:
    """Sum of 1 - co_change_rate over the edges whose boundary moved."""
    return edges.agg(F.coalesce(F.sum(F.when(F.col("boundary") != F.col("baseline"), 1 - F.col("rate"))), F.lit(0.0)).alias("defect"), F.count_if(F.col("boundary") != F.col("baseline")).alias("n_moved"))


def reap(edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """Regions at moved edges and those a cascade from them reaches: what a cache has to drop."""
    moved = edges.filter(F.col("boundary") != F.col("baseline"))
    return cascade(edges, moved.select(F.col("a").alias("region")).unionByName(moved.select(F.col("b").alias("region"))), max_depth)
