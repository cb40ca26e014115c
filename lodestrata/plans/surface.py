"""Queries over the rest of the surface: metadata, tree encodings, change cascades, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import encoding as E
from lodestrata.operators import hypervectors as H
from lodestrata.operators import surface as U
from lodestrata.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


_NAMES = ("ast_nodes", "content_chunks", "content_manifest", "lsp_defs", "lsp_refs", "lsp_symbols", "node_refs", "nodes", "source_files")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _NAMES))
def meta_row_counts(s, d):
    return U.row_counts({t: table(s, d, t) for t in _NAMES})


@query("SELECT table_name AS \"table\", column_name AS \"column\", (ordinal_position - 1)::INT AS position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _NAMES) + ")")
def meta_schema(s, d):
    return U.describe({t: table(s, d, t) for t in _NAMES}).select("table", "column", "position")


@query("""WITH f AS (SELECT a.source_id, a.start_row, a.start_col FROM ast_nodes a WHERE a.node_id = (SELECT min(l.node_id) FROM lsp_defs l JOIN ast_nodes x ON x.node_id = l.node_id) LIMIT 1),
n AS (SELECT a.node_id FROM ast_nodes a, f WHERE a.source_id = f.source_id AND (a.start_row < f.start_row OR (a.start_row = f.start_row AND a.start_col <= f.start_col)) AND (a.end_row > f.start_row OR (a.end_row = f.start_row AND a.end_col >= f.start_col)) ORDER BY a.end_byte - a.start_byte, a.node_id LIMIT 1)
SELECT node_id, def_token, def_uri FROM lsp_defs WHERE node_id IN (SELECT node_id FROM n)""")
def lsp_defs_at(s, d):
    a, defs = table(s, d, "ast_nodes"), table(s, d, "lsp_defs")
    first = a.join(defs.select("node_id").distinct(), "node_id", "left_semi").orderBy("node_id").first()
    return U.at_position(defs, a, first["source_id"], first["start_row"], first["start_col"]).select("node_id", "def_token", "def_uri")


@query()
def hv_encode_trees(s, d):
    """Not SQL: rotations of long bit vectors; its test compares it with recursion."""
    return E.encode_trees(table(s, d, "ast_nodes")).select("source_id", F.aggregate("hv", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)).alias("n_set"))


@query()
def hv_tree_neighbours(s, d):
    """The trees nearest to the first file's tree by Hamming distance."""
    h = E.encode_trees(table(s, d, "ast_nodes"))
    return H.radius_top_k(h, h.orderBy("source_id").first()["hv"], "hv", "source_id", 3500, 20)


_ALL_EDGES = "e AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b, o_orderpriority AS boundary, '1-URGENT' AS baseline, (o_orderkey % 10) / 10.0 AS rate FROM orders)"


def _all_edges(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_orderpriority").alias("boundary"), F.lit("1-URGENT").alias("baseline"), (F.col("o_orderkey") % 10 / 10.0).alias("rate")).distinct()


@query(f"""WITH RECURSIVE {_ALL_EDGES}, u AS (SELECT a AS f, b AS t FROM e WHERE boundary <> baseline UNION SELECT b, a FROM e WHERE boundary <> baseline), r AS (SELECT (SELECT min(a) FROM e) AS region, 0 AS depth UNION SELECT u.t, r.depth + 1 FROM r JOIN u ON u.f = r.region WHERE r.depth < 3)
SELECT region, min(depth) AS depth FROM r GROUP BY 1""")
def sheaf_cascade_all(s, d):
    e = _all_edges(s, d)
    return U.cascade(e, e.agg(F.min("a").alias("region")), 3)


@query(f"WITH {_ALL_EDGES} SELECT round(sum(CASE WHEN boundary <> baseline THEN 1 - rate END), 6) AS defect, count(*) FILTER (boundary <> baseline) AS n_moved FROM e")
def sheaf_cache_defect_all(s, d):
    return U.cache_defect(_all_edges(s, d)).withColumn("defect", F.round("defect", 6))


@query(f"WITH {_ALL_EDGES} SELECT DISTINCT unnest([a, b]) AS region, 0 AS depth FROM e WHERE boundary <> baseline")
def sheaf_reap_all(s, d):
    return U.reap(_all_edges(s, d))
