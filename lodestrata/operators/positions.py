"""From positions to nodes: the smallest syntax node around a row and column, for one position or for many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.patterns import strip_file_uri

BUCKET_ROWS = 64


def node_at(ast: DataFrame, source: str, row: int, col: int) -> DataFrame:
    """The innermost node around one position (smallest byte span; the smaller id among equals)."""
    hit = ast.filter((F.col("source_id") == source) & _contains(F.lit(row), F.lit(col)))
    return hit.orderBy(F.col("end_byte") - F.col("start_byte"), "node_id").limit(1)


def _contains(row, col):
    after = (F.col("start_row") < row) | ((F.col("start_row") == row) & (F.col("start_col") <= col))
    before = (F.col("end_row") > row) | ((F.col("end_row") == row) & (F.col("end_col") >= col))
    return after & before


def enclosing_nodes(positions: DataFrame, ast: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Innermost node of each position (key columns source_id, row, col kept): a range join by buckets of rows.

    A node is listed in every bucket of 64 rows that it covers, a position falls into one, so the join has equality keys
    (source_id, bucket) and no file's positions and nodes meet in full. Positions outside every node are left out.
    """
    nodes = ast.select("node_id", "source_id", "node_kind", "start_row", "start_col", "end_row", "end_col", "start_byte", "end_byte").distinct()
    if kinds:
        nodes = nodes.filter(F.col("node_kind").isin(*kinds))
    nodes = nodes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_row") / BUCKET_ROWS), F.floor(F.col("end_row") / BUCKET_ROWS))))
    pos = positions.withColumn("bucket", F.floor(F.col("row") / BUCKET_ROWS))
    hit = pos.join(nodes, ["source_id", "bucket"]).filter(_contains(F.col("row"), F.col("col")))
    best = hit.groupBy(*positions.columns).agg(F.min(F.struct((F.col("end_byte") - F.col("start_byte")).alias("span"), "node_id", "node_kind")).alias("b"))
    return best.select(*positions.columns, "b.node_id", "b.node_kind")


def referrers(lsp_refs: DataFrame, ast: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """For each reference site of the language server, the innermost node (optionally of some kinds) around it."""
    sites = lsp_refs.select(F.regexp_replace(strip_file_uri(F.col("ref_uri")), "^/", "").alias("source_id"), F.col("ref_start_line").alias("row"), F.col("ref_start_col").alias("col"), "ref_token").distinct()
    return enclosing_nodes(sites, ast, kinds)


def symbols_to_nodes(symbols: DataFrame, ast: DataFrame) -> DataFrame:
    """Language-server symbols merged into the syntax tree of their own file; none inside falls back to `_lsp/line:col`."""
    src = symbols.select(F.regexp_extract("node_id", r"^(.*?\.[A-Za-z]+)/", 1).alias("source_id"), F.col("start_line").alias("row"), F.col("start_col").alias("col")).distinct()
    got = enclosing_nodes(src, ast)
    j = src.join(got, ["source_id", "row", "col"], "left")
    return j.select("source_id", "row", "col", F.coalesce("node_id", F.concat(F.lit("_lsp/"), F.col("row").cast("string"), F.lit(":"), F.col("col").cast("string"))).alias("node_id"))


def discernible_ids(symbols: DataFrame) -> DataFrame:
    """Ids that tell overloads apart: name, then #detail, then ~n for what is still equal (n from 2 in order of position)."""
    from pyspark.sql import Window as W

    base = symbols.filter(F.col("detail").isNotNull() & (F.col("detail") != "")).select(F.regexp_extract("node_id", r"^(.*?\.[A-Za-z]+)/", 1).alias("source_id"), "detail", "start_line", "start_col").distinct()
    n = F.row_number().over(W.partitionBy("source_id", "detail").orderBy("start_line", "start_col"))
    return base.withColumn("n", n).select("source_id", "start_line", "start_col", F.concat(F.col("detail"), F.when(F.col("n") > 1, F.concat(F.lit("~"), F.col("n").cast("string"))).otherwise(F.lit(""))).alias("label"))
