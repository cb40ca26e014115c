"""Hypervectors of syntax trees: every file's tree as one 8192-bit vector, without gathering a file's nodes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.kinds import bucket_arity
from lodestrata.operators.hypervectors import HV_BITS, bundle, expand_seed, rotate_bits
from lodestrata.session import Workspace


def seed_of(kind: str, arity: int) -> int:
    """Seed of a node's own vector (SHA-256 takes the place of a hash that isn't available here)."""
    return int.from_bytes(hashlib.sha256(f"{kind}:{arity}".encode()).digest()[:8], "little")


def rotations(ast: DataFrame) -> DataFrame:
    """(node_id, source_id, node_kind, arity, turn): each node's kind, arity bucket and total rotation from the root.

    A child is rotated by its position among its siblings plus one, on top of its parent's rotation. Positions come from a
    window over siblings; sums go down level by level, so the number of steps is the depth of the deepest tree.
    """
    ws = Workspace(ast.sparkSession, "encode")
    n = ast.select("node_id", "source_id", "node_kind", "start_byte").dropDuplicates(["node_id"]).withColumn("up", F.regexp_replace("node_id", "/[^/]*$", ""))
    kids = n.groupBy("up").agg(F.count(F.lit(1)).alias("n_kids"))
    pos = F.row_number().over(W.partitionBy("up").orderBy("start_byte", "node_id"))
    n = n.withColumn("pos", pos).join(kids.select(F.col("up").alias("me"), "n_kids"), F.col("node_id") == F.col("me"), "left")
    n = ws.write(n.select("node_id", "source_id", "node_kind", "up", "pos", bucket_arity(F.coalesce("n_kids", F.lit(0))).alias("arity")))
    ids = n.select(F.col("node_id").alias("parent"))
    linked = ws.write(n.join(ids, F.col("up") == F.col("parent"), "left"))
    front = linked.filter("parent IS NULL").select("node_id", "source_id", "node_kind", "arity", F.lit(0).alias("turn"))
    rest, out = linked.filter("parent IS NOT NULL"), front
    while True:
        nxt = ws.write(rest.join(front.select(F.col("node_id").alias("parent"), F.col("turn").alias("t")), "parent").select("node_id", "source_id", "node_kind", "arity", F.pmod(F.col("t") + F.col("pos"), F.lit(HV_BITS)).cast("int").alias("turn")))
        if not nxt.limit(1).count():
            return out
        out, front = out.unionByName(nxt), nxt


def encode_trees(ast: DataFrame) -> DataFrame:
    """(source_id, hv): XOR over a file's nodes of the node's own vector rotated by its total rotation.

    Equal to encoding bottom up (own vector XOR each child's vector rotated by its position plus one), since rotation
    distributes over XOR. Partitions fold what they hold of each file first; then words are folded per file.
    """

    def fold(batches):
        seeds: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            acc: dict[str, np.ndarray] = {}
            for sid, kind, arity, turn in zip(pdf["source_id"], pdf["node_kind"], pdf["arity"], pdf["turn"]):
                own = seeds.get((kind, arity))
                if own is None:
                    own = seeds[(kind, arity)] = expand_seed(seed_of(kind, arity))
                v = rotate_bits(own, int(turn))
                acc[sid] = v if sid not in acc else acc[sid] ^ v
            yield pd.DataFrame({"source_id": list(acc), "hv": [v.view("<i8") for v in acc.values()]})

    part = rotations(ast).filter("source_id IS NOT NULL").select("source_id", "node_kind", "arity", "turn").mapInPandas(fold, "source_id string, hv array<bigint>")
    return bundle(part, ["source_id"], "hv")
