"""Finding rules over fact views: a rule is SQL with required views; findings are compared with a baseline."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """id, the views it requires, and a statement that returns source_id, node_id, start_row, message."""

    id: str
    requires: tuple[str, ...]
    sql: str


def site_lines(files: DataFrame) -> DataFrame:
    """(source_id, row, line) of every line of every distinct text; rows count from 0."""
    text = F.decode("content", "UTF-8")
    one = files.filter(F.col("content").isNotNull()).select(F.col("id").alias("source_id"), text.alias("t")).distinct()
    return one.select("source_id", F.posexplode(F.split("t", "\r?\n")).alias("row", "line"))


# The rules that come with the engine.
RULES = (
    Rule("unwrap_without_expect", ("site_lines",), "SELECT source_id, source_id AS node_id, row AS start_row, 'unwrap() outside tests' AS message FROM site_lines WHERE source_id LIKE '%.rs' AND source_id NOT LIKE '%/tests/%' AND line LIKE '%.unwrap()%'"),
    Rule("sleep_in_tests", ("site_lines",), "SELECT source_id, source_id AS node_id, row AS start_row, 'sleep in a test' AS message FROM site_lines WHERE source_id LIKE '%/tests/%' AND line LIKE '%sleep(%'"),
    Rule("merge_marker", ("site_lines",), "SELECT source_id, source_id AS node_id, row AS start_row, 'merge marker' AS message FROM site_lines WHERE line LIKE '<<<<<<< %' OR line LIKE '>>>>>>> %'"),
    Rule("todo_without_owner", ("site_lines",), "SELECT source_id, source_id AS node_id, row AS start_row, 'pending note' AS message FROM site_lines WHERE line LIKE '%TODO: %'"),
)


def findings(spark: SparkSession, views: dict[str, DataFrame], rules=RULES) -> DataFrame:
    """(rule_id, source_id, node_id, start_row, message) of all rules whose views exist; others are skipped.

    Views have names of their own while statements are read, so those of the session are neither hidden nor replaced.
    """
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in views}
    for name, df in views.items():
        df.createOrReplaceTempView(own[name])
    out = None
    for r in rules:
        if all(v in views for v in r.requires):
            text = re.sub(r"\b(" + "|".join(map(re.escape, own)) + r")\b(?!')", lambda m: own[m[1]], r.sql)
            part = spark.sql(text).select(F.lit(r.id).alias("rule_id"), "source_id", "node_id", "start_row", "message")
            out = part if out is None else out.unionByName(part)
    for name in own.values():
        spark.catalog.dropTempView(name)
    return out if out is not None else spark.createDataFrame([], "rule_id string, source_id string, node_id string, start_row int, message string")


def beyond_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Counts per rule and file that exceed the baseline's (0 where it has none)."""
    n = found.groupBy("rule_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    b = baseline.select("rule_id", "source_id", F.col("count").alias("allowed"))
    return n.join(b, ["rule_id", "source_id"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(0))).filter(F.col("n") > F.col("allowed"))
