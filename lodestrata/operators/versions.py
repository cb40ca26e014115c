"""Versions of fact tables: snapshots, incremental diffs, overlays, subtree rewrites, splices."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file by a rename, so a reader sees the old text or the new one."""
    fs, now = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(now, False)
    fs.rename(tmp, now)


def _get(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(p) else None


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, digest) that CURRENT points at; None before the first snapshot."""
    text = _get(spark, f"{root}/CURRENT")
    return None if text is None else (int(text.split()[0]), text.split()[1])


def snapshot(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Writes tables under root/v=<version>, then points root/CURRENT at it by a rename; returns the head's digest.

    The head (version, tables with rows and schema, parent's digest) lies beside the tables, so heads form a chain: a
    digest stands for a state and for all states before it.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = {}
    for name, df in sorted(tables.items()):
        path = f"{root}/v={version}/{name}"
        df.write.mode("overwrite").parquet(path)
        manifest[name] = {"rows": spark.read.parquet(path).count(), "schema": df.schema.jsonValue()}
    return _head(spark, root, version, {"version": version, "tables": manifest})


def _head(spark: SparkSession, root: str, version: int, what: dict) -> str:
    before = current(spark, root)
    text = json.dumps(what | {"parent": None if before is None else list(before)}, sort_keys=True)
    digest = hashlib.sha256(text.encode()).hexdigest()
    _put(spark, f"{root}/heads/{version}.json", text)
    _put(spark, f"{root}/CURRENT", f"{version} {digest}")
    return digest


def history(spark: SparkSession, root: str) -> DataFrame:
    """(position, version, digest, reverts_to, intact) from the newest head down the chain; a head whose text hasn't the
    digest it is known by isn't intact, and what lies before it can't be trusted either."""
    at, rows, good = current(spark, root), [], True
    while at is not None:
        text = _get(spark, f"{root}/heads/{at[0]}.json")
        good = good and text is not None and hashlib.sha256(text.encode()).hexdigest() == at[1]
        head = json.loads(text) if text is not None else {}
        rows.append((len(rows), at[0], at[1], head.get("reverts_to"), good))
        at = tuple(head["parent"]) if head.get("parent") else None
    return spark.createDataFrame(rows, "position int, version int, digest string, reverts_to int, intact boolean")


def revert(spark: SparkSession, root: str, to: int, version: int) -> str:
    """A new version that reads as version `to` does: a head without tables of its own; nothing is rewritten or lost."""
    text = _get(spark, f"{root}/heads/{to}.json")
    if text is None:
        raise ValueError(f"no version {to}")
    head = json.loads(text)
    return _head(spark, root, version, {"version": version, "tables": head["tables"], "reverts_to": head.get("reverts_to", to)})


def load_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the current one by default; a reverting version reads the one that it reverts to."""
    if version is None:
        version = current(spark, root)[0]
    head = json.loads(_get(spark, f"{root}/heads/{version}.json"))
    return spark.read.parquet(f"{root}/v={head.get('reverts_to', version)}/{name}")


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed between two states of one row per key; equal rows are left out.

    Only keys and a hash of the compared columns are shuffled.
    """
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]) if columns else F.lit(0)
    a = old.select(F.col(key).alias("k"), h.alias("ha"), F.lit(1).alias("ia"))
    b = new.select(F.col(key).alias("k"), h.alias("hb"), F.lit(1).alias("ib"))
    j = a.join(b, "k", "full")
    change = F.when(F.col("ia").isNull(), "added").when(F.col("ib").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed")
    return j.select(F.col("k").alias(key), change.alias("change")).filter("change IS NOT NULL")


def overlay(live: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """Live rows with a shadow's rows in their place; rows of the shadow whose tombstone is 1 hide the live ones."""
    cols = [c for c in live.columns]
    s = shadow.select(F.col(key).alias("_k"), "tombstone", *[F.col(c).alias(f"_s_{c}") for c in cols if c != key])
    j = live.join(s, F.col(key) == F.col("_k"), "full").filter(F.coalesce("tombstone", F.lit(0)) == 0)
    return j.select(F.coalesce(key, "_k").alias(key), *[F.when(F.col("_k").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in cols if c != key]).select(*cols)


def rename_subtree(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Moves a node and everything below it to another path, ids and parent ids alike."""
    def moved(c):
        return F.when(F.col(c) == old, F.lit(new)).when(F.startswith(F.col(c), F.lit(old + "/")), F.concat(F.lit(new), F.substring(F.col(c), F.lit(len(old) + 1), F.length(c)))).otherwise(F.col(c))

    return nodes.withColumns({"id": moved("id"), "parent_id": moved("parent_id"), "name": F.when(F.col("id") == old, F.lit(new.rsplit("/", 1)[-1])).otherwise(F.col("name"))})


def remove_subtree(nodes: DataFrame, root: str) -> DataFrame:
    return nodes.filter(~((F.col("id") == root) | F.startswith(F.col("id"), F.lit(root + "/"))))


def splice(source: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Applies (start, end, replacement) to a text, from the last to the first; edits that overlap raise."""
    done, limit = source, len(source)
    for start, end, text in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if not 0 <= start <= end <= limit:
            raise ValueError(f"edit {start}..{end} overlaps another or lies outside")
        done, limit = done[:start] + text + done[end:], start
    return done
