"""Queries of the general data-quality operators: orphan references, per-key results under skew, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as H
from lodestrata.operators import integrity as I
from lodestrata.operators import skew as S
from lodestrata.session import table

_REFERRED = ("content_manifest", "node_refs", "lsp_refs", "ast_nodes", "content_chunks", "source_files", "deletions")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return I.all_orphans({n: table(spark, d, n) for n in _REFERRED})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is missing, deleted or later."""
    return _orphans(spark, d).select("ref_table", "ref_key", "target_key").distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Their counts per table and month."""
    return I.orphan_counts(_orphans(spark, d))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    refs = S.per_key_profile(table(spark, d, "node_refs"), "token", {"nodes": "node_id", "files": "source_id"})
    defs = S.per_key_profile(table(spark, d, "lsp_defs"), "def_token", {"nodes": "node_id", "files": "def_uri"})
    return refs.select(F.lit("node_refs").alias("tok_table"), "token", "rows", "n_nodes", "n_files").unionByName(
        defs.select(F.lit("lsp_defs").alias("tok_table"), F.col("def_token").alias("token"), "rows", "n_nodes", "n_files")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that hold at least 2 % of their table's rows: their weights over files, which repeat most, are added up."""
    out = None
    for name, key, value in (("node_refs", "token", "source_id"), ("lsp_defs", "def_token", "def_uri")):
        t = table(spark, d, name)
        per = S.per_key_profile(t, key, {"files": value}).filter(F.col(key).isNotNull())
        total = t.agg(F.count(F.lit(1)).alias("total"))  # one row, from the footers of the files
        part = per.crossJoin(F.broadcast(total)).filter(F.col("rows") * 50 >= F.col("total")).select(F.lit(name).alias("tok_table"), F.col(key).alias("token"))
        out = part if out is None else out.unionByName(part)
    return out


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct nodes and distinct files or uris of every token."""
    return _tokens(spark, d)


def p4_modes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent container of each call token."""
    return S.per_key_mode(table(spark, d, "node_refs"), "token", "container_node_id")


def p4_medians(spark: SparkSession, d: str) -> DataFrame:
    """The lower median of the start line of each defined token."""
    return S.per_key_percentile(table(spark, d, "lsp_defs"), "def_token", "def_start_line", 0.5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node."""
    return H.hierarchy(table(spark, d, "nodes")).select("id", "root_id", "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path of names of every node."""
    return H.hierarchy(table(spark, d, "nodes"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each node below it."""
    return H.descendants(table(spark, d, "nodes"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p4_found, p4_tokens, p4_modes, p4_medians, p6_found, p6_paths, p6_descendants)}

_P3 = """
WITH refs AS (
  SELECT 'content_manifest' AS ref_table, node_id || '#' || seq AS ref_key, lower(hex(chunk_hash)) AS target_key, 'content_chunks' AS tgt, ingested_at FROM content_manifest WHERE chunk_hash IS NOT NULL
  UNION ALL SELECT 'node_refs', source_id, node_id, 'ast_nodes', ingested_at FROM node_refs WHERE node_id IS NOT NULL
  UNION ALL SELECT 'lsp_refs', ref_uri, referrer_node_id, 'ast_nodes', ingested_at FROM lsp_refs WHERE referrer_node_id IS NOT NULL
  UNION ALL SELECT 'ast_nodes', node_id, source_id, 'source_files', ingested_at FROM ast_nodes WHERE source_id IS NOT NULL),
keys AS (
  SELECT 'content_chunks' AS tgt, lower(hex(chunk_hash)) AS pk, min(ingested_at) AS born, max(ingested_at) AS newest FROM content_chunks GROUP BY 1, 2
  UNION ALL SELECT 'ast_nodes', node_id, min(ingested_at), max(ingested_at) FROM ast_nodes GROUP BY 1, 2
  UNION ALL SELECT 'source_files', id, min(ingested_at), max(ingested_at) FROM source_files GROUP BY 1, 2),
gone AS (SELECT del_table, del_key, max(deleted_at) AS deleted_at FROM deletions GROUP BY 1, 2),
cases AS (
  SELECT r.* FROM refs r LEFT JOIN keys k ON r.tgt = k.tgt AND r.target_key = k.pk LEFT JOIN gone g ON g.del_table = r.tgt AND g.del_key = r.target_key
  WHERE k.pk IS NULL OR g.deleted_at >= k.newest OR k.born > r.ingested_at)
"""

_TREE = """
WITH RECURSIVE cur AS (
  SELECT id, nullif(parent_id, '') AS parent_id, name FROM nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY mtime DESC NULLS LAST, nullif(parent_id, '') DESC NULLS LAST, name DESC NULLS LAST) = 1),
tree AS (
  SELECT c.id, c.id AS root_id, CAST(0 AS BIGINT) AS depth, coalesce(c.name, '') AS path FROM cur c WHERE c.parent_id IS NULL OR c.parent_id NOT IN (SELECT id FROM cur)
  UNION ALL SELECT c.id, t.root_id, t.depth + 1, t.path || '/' || coalesce(c.name, '') FROM cur c JOIN tree t ON c.parent_id = t.id),
lost AS (SELECT * FROM cur WHERE id NOT IN (SELECT id FROM tree)),
walk AS (
  SELECT id AS start, id AS at FROM lost
  UNION SELECT w.start, l.parent_id FROM walk w JOIN lost l ON l.id = w.at),
oncycle AS (SELECT DISTINCT w.start AS id FROM walk w JOIN lost l ON l.id = w.at WHERE l.parent_id = w.start),
ends AS (SELECT w.start AS id, min(w.at) AS root_id FROM walk w JOIN oncycle o ON o.id = w.at GROUP BY 1),
everything AS (
  SELECT id, root_id, depth, path FROM tree
  UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT), NULL FROM ends)
"""

ORACLES = {
    "p3_found": _P3 + "SELECT DISTINCT ref_table, ref_key, target_key FROM cases",
    "p3_counts": _P3 + "SELECT ref_table, date_trunc('month', ingested_at) AS month, count(DISTINCT (coalesce(ref_key, '~'), target_key)) AS n_references, count(*) AS n_rows, count(DISTINCT target_key) AS n_targets FROM cases GROUP BY 1, 2",
    "p4_found": """
        SELECT 'node_refs' AS tok_table, token FROM node_refs WHERE token IS NOT NULL GROUP BY token HAVING count(*) * 50 >= (SELECT count(*) FROM node_refs)
        UNION ALL SELECT 'lsp_defs', def_token FROM lsp_defs WHERE def_token IS NOT NULL GROUP BY def_token HAVING count(*) * 50 >= (SELECT count(*) FROM lsp_defs)""",
    "p4_tokens": """
        SELECT 'node_refs' AS tok_table, token, count(*) AS rows, count(DISTINCT node_id) AS n_nodes, count(DISTINCT source_id) AS n_files FROM node_refs GROUP BY token
        UNION ALL SELECT 'lsp_defs', def_token, count(*), count(DISTINCT node_id), count(DISTINCT def_uri) FROM lsp_defs GROUP BY def_token""",
    "p4_modes": """
        SELECT token, container_node_id AS mode, n AS mode_rows FROM (SELECT token, container_node_id, count(*) AS n FROM node_refs WHERE container_node_id IS NOT NULL GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, container_node_id) = 1""",
    "p4_medians": "SELECT def_token, CAST(quantile_disc(def_start_line, 0.5) AS DOUBLE) AS percentile FROM lsp_defs WHERE def_start_line IS NOT NULL GROUP BY def_token",
    "p6_found": _TREE + "SELECT id, root_id, depth FROM everything",
    "p6_paths": _TREE + "SELECT id, root_id, depth, path FROM everything",
    "p6_descendants": _TREE + """, below AS (
  SELECT t.id AS descendant_id, c.parent_id AS id, CAST(1 AS BIGINT) AS distance FROM tree t JOIN cur c ON c.id = t.id WHERE t.depth > 0
  UNION ALL SELECT b.descendant_id, c.parent_id, b.distance + 1 FROM below b JOIN tree t ON t.id = b.id JOIN cur c ON c.id = t.id WHERE t.depth > 0)
SELECT id, descendant_id, distance FROM below""",
}
