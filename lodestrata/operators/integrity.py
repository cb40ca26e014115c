"""References to records that do not exist: missing, deleted, or later than the reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import heavy_keys, salted_join
from lodestrata.session import Workspace

BROADCAST_KEYS = 200_000  # bad keys that may be broadcast: some 30 MB


@dataclass(frozen=True)
class Reference:
    """A foreign key: columns of the referring table, and the table and key it names."""

    table: str
    ref_key: str  # SQL expression
    key: str
    target: str
    target_key: str
    binary: bool = False


REFERENCES = (
    Reference("content_manifest", "concat(node_id, '#', seq)", "chunk_hash", "content_chunks", "chunk_hash", True),
    Reference("node_refs", "source_id", "node_id", "ast_nodes", "node_id"),
    Reference("lsp_refs", "ref_uri", "referrer_node_id", "ast_nodes", "node_id"),
    Reference("ast_nodes", "node_id", "source_id", "source_files", "id"),
)


def parent_keys(targets: DataFrame, key: str, deletions: DataFrame, table: str, binary: bool = False) -> DataFrame:
    """Keys that live: (pk, born). Born is the first ingested_at; a key deleted at or after its last one is left out.

    A key without any ingested_at has born NULL and counts as always there, unless deleted. NULL keys are no keys. Binary
    keys are named by lower-case hex in the log of deletions; other spellings name none.
    """
    held = targets.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("pk")).agg(F.min("ingested_at").alias("born"), F.max("ingested_at").alias("last"))
    gone = deletions.filter((F.col("del_table") == table) & F.col("del_key").isNotNull() & F.col("deleted_at").isNotNull())
    if binary:
        gone = gone.withColumn("raw", F.unhex("del_key")).filter(F.lower(F.hex("raw")) == F.col("del_key")).withColumn("del_key", F.col("raw"))
    gone = gone.groupBy("del_key").agg(F.max("deleted_at").alias("deleted_at"))
    return held.join(gone, F.col("pk") == F.col("del_key"), "left").filter(F.col("deleted_at").isNull() | (F.col("last") > F.col("deleted_at"))).select("pk", "born")


def bad_keys(refs: DataFrame, ref: Reference, targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """(fk, n, pk, born): foreign keys of which some reference has no target, with their rows and the target's birth, if any.

    Left anti-join of the distinct non-NULL foreign keys, each with its earliest reference, against the living parent
    keys: a key stays if no living parent was born by then. Keys are folded straight from the scan, so what is shuffled
    is a key and two numbers, however many references a key has.
    """
    keys = refs.filter(F.col(ref.key).isNotNull()).groupBy(F.col(ref.key).alias("fk")).agg(F.min("ingested_at").alias("first_ref"), F.count(F.lit(1)).alias("n"))
    living = parent_keys(targets, ref.target_key, deletions, ref.target, ref.binary)
    bad = keys.join(living, (F.col("fk") == F.col("pk")) & (F.col("born").isNull() | F.col("first_ref").isNull() | (F.col("born") <= F.col("first_ref"))), "left_anti")
    return bad.join(living, F.col("fk") == F.col("pk"), "left").select("fk", "n", "pk", "born")


def all_orphans(tables: dict[str, DataFrame], references=REFERENCES, share: float = 1e-3, salts: int = 32, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows (ref_table, ref_key, target_key, month, n_rows) of the references whose target does not exist for them.

    First the bad keys of all references, in one job and written; then each table is read once more and joined with its
    few bad keys: references from before the parent's birth, or to a parent that never lives, are the cases. Up to
    `most` bad keys are broadcast, so references aren't shuffled; beyond that they are joined by a shuffle in which keys
    that hold over `share` of the rows are salted. A reference is a distinct (ref_key, target_key); n_rows counts its
    rows of that month (of the reference's ingested_at) that are cases. NULL foreign keys are no cases; a NULL
    ingested_at of a reference is never before a birth; a NULL ref_key stays NULL in the result.
    """
    spark = tables[references[0].table].sparkSession
    ws, found = Workspace(spark, "orphans"), None
    for i, r in enumerate(references):
        bad = bad_keys(tables[r.table], r, tables[r.target], tables["deletions"])
        bad = bad.select(F.lit(i).alias("ref"), F.col("fk").cast("binary").alias("fk"), "n", F.col("pk").isNotNull().alias("lives"), "born")
        found = bad if found is None else found.unionByName(bad)
    found = ws.write(found)
    sizes = {x["ref"]: x["keys"] for x in found.groupBy("ref").agg(F.count(F.lit(1)).alias("keys")).collect()}  # a row per reference
    out = None
    for i, r in enumerate(references):
        refs = tables[r.table].filter(F.col(r.key).isNotNull()).select(F.expr(r.ref_key).alias("ref_key"), F.col(r.key).alias("fk"), "ingested_at")
        bad = found.filter(F.col("ref") == i).select(F.col("fk") if r.binary else F.decode("fk", "UTF-8").alias("fk"), "n", "lives", "born")
        if sizes.get(i, 0) <= most:
            back = refs.join(F.broadcast(bad.drop("n")), "fk")
        else:
            back = salted_join(refs, bad.drop("n"), "fk", heavy_keys(bad, "fk", "n", tables[r.table].count(), share), salts, "ref_key")
        back = back.filter(~F.col("lives") | (F.col("ingested_at") < F.col("born")))
        shown = F.lower(F.hex("fk")) if r.binary else F.col("fk")
        part = back.groupBy(F.lit(r.table).alias("ref_table"), "ref_key", shown.alias("target_key"), F.date_trunc("month", "ingested_at").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def orphan_references(refs: DataFrame, ref: Reference, targets: DataFrame, deletions: DataFrame, share: float = 1e-3, salts: int = 32, most: int = BROADCAST_KEYS) -> DataFrame:
    """The orphans of one reference, as `all_orphans` gives them."""
    return all_orphans({ref.table: refs, ref.target: targets, "deletions": deletions} if ref.table != ref.target else {ref.table: refs, "deletions": deletions}, (ref,), share, salts, most)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Counts per table and month: references, rows, and distinct missing keys."""
    return orphans.groupBy("ref_table", "month").agg(F.count(F.lit(1)).alias("n_references"), F.sum("n_rows").alias("n_rows"), F.countDistinct("target_key").alias("n_targets"))
