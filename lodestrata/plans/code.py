"""Queries over code facts: listings, references and definitions, positions, graphs of calls, chunks, versions, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import kinds as K
from lodestrata.operators import chunks as C
from lodestrata.operators import extraction as X
from lodestrata.operators import facts as A
from lodestrata.operators import graphs as G
from lodestrata.operators import integrity as I
from lodestrata.operators import positions as P
from lodestrata.operators import resolution as N
from lodestrata.operators import rules as R
from lodestrata.operators import versions as V
from lodestrata.session import table

TOKEN = "emit"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _defs(s: SparkSession, d: str) -> DataFrame:
    return A.node_defs(table(s, d, "lsp_symbols"), table(s, d, "ast_nodes"))


_DEFS = r"""
named AS (SELECT DISTINCT node_id, regexp_extract(detail, '^(?:func \([^)]*\) )?[^(]*?(\w+)\s*(?:<[^>]*>)?\(', 1) AS token, symbol_kind AS canonical_kind FROM lsp_symbols WHERE detail IS NOT NULL),
fns AS (SELECT DISTINCT node_id, source_id FROM ast_nodes WHERE node_kind IN ('function_declaration', 'method_declaration', 'function_definition', 'function_item', 'method_definition')),
defs AS (SELECT token, node_id, source_id, CASE WHEN regexp_replace(node_id, '/[^/]*$', '') <> source_id THEN regexp_replace(node_id, '/[^/]*$', '') END AS container_node_id, canonical_kind FROM named JOIN fns USING (node_id) WHERE token <> '')
"""
_CLASS = """CASE WHEN node_kind IN ('function_declaration', 'function_item', 'function_definition') THEN 'function' WHEN node_kind IN ('method_declaration', 'method_item') THEN 'method'
 WHEN node_kind IN ('type_declaration', 'struct_item', 'enum_item', 'trait_item', 'type_spec') THEN 'type' ELSE 'unknown' END"""

# ---------------------------------------------------------------- scans, projections, predicates


@query("SELECT count(*) AS n_files, sum(octet_length(content)) AS n_bytes FROM source_files WHERE content IS NOT NULL AND octet_length(content) <= 8388608 AND NOT regexp_matches(hex(content)[1:16384], '^(..)*?00')")
def scan_readable(s, d):
    return A.readable(table(s, d, "source_files")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"))


@query("""SELECT id, CASE regexp_extract(id, '\\.([^./]+)$', 1) WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'sh' THEN 'bash' END AS detected FROM (SELECT DISTINCT id FROM source_files)""")
def scan_languages(s, d):
    return table(s, d, "source_files").select("id").distinct().select("id", K.language_of(F.col("id")).alias("detected"))


@query("SELECT DISTINCT id, name, kind, size FROM nodes WHERE parent_id IS NULL OR parent_id = ''")
def nodes_roots(s, d):
    return A.list_roots(table(s, d, "nodes"))


_PARENT = "(SELECT parent_id FROM nodes WHERE parent_id <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _parent(s, d):
    return table(s, d, "nodes").filter("parent_id <> ''").groupBy("parent_id").count().orderBy(F.desc("count"), "parent_id").first()[0]


@query(f"SELECT DISTINCT id, name, kind, size FROM nodes WHERE parent_id = {_PARENT}")
def nodes_children(s, d):
    return A.list_children(table(s, d, "nodes"), _parent(s, d))


@query(f"SELECT id, name, kind, mtime FROM nodes WHERE id = {_PARENT}")
def nodes_get(s, d):
    return A.get_node(table(s, d, "nodes"), _parent(s, d)).select("id", "name", "kind", "mtime")


@query("SELECT DISTINCT id, record FROM nodes WHERE kind = 0 AND record IS NOT NULL AND record <> ''")
def nodes_contents(s, d):
    return A.file_contents(table(s, d, "nodes"))


@query("""WITH RECURSIVE up AS (SELECT DISTINCT regexp_replace(id, '/[^/]*$', '') AS id FROM source_files WHERE id LIKE '%/%'
 UNION SELECT regexp_replace(id, '/[^/]*$', '') FROM up WHERE id LIKE '%/%')
SELECT id, CASE WHEN id LIKE '%/%' THEN regexp_replace(id, '/[^/]*$', '') ELSE '' END AS parent_id, regexp_extract(id, '([^/]+)$', 1) AS name, 1 AS kind FROM up""")
def nodes_directories(s, d):
    return A.directory_rows(table(s, d, "source_files").select(F.col("id").alias("path")))


@query("SELECT token, node_id, source_id, container_node_id, qualifier FROM node_refs WHERE token = 'emit'")
def refs_callers(s, d):
    return A.find_callers(table(s, d, "node_refs"), TOKEN)


@query(f"WITH {_DEFS} SELECT * FROM defs WHERE token LIKE '%snapshot%'")
def defs_find(s, d):
    return _defs(s, d).filter(F.col("token").contains("snapshot"))


@query(f"WITH {_DEFS} SELECT * FROM defs")
def defs_all(s, d):
    return _defs(s, d)


@query(f"SELECT {_CLASS} AS kind, CASE WHEN node_kind IN ('function_declaration', 'function_definition', 'function_item') THEN 1 WHEN node_kind IN ('method_declaration', 'method_definition') THEN 2 WHEN node_kind IN ('class_declaration', 'class_definition', 'impl_item') THEN 3 ELSE 0 END AS tag, count(*) AS n FROM ast_nodes GROUP BY 1, 2")
def ast_kinds(s, d):
    return table(s, d, "ast_nodes").groupBy(K.symbol_class(F.col("node_kind")).alias("kind"), K.semantic_tag(F.col("node_kind")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


_CANONICAL_SQL = """CASE WHEN node_kind IN ('parameter', 'parameters', 'parameter_declaration', 'typed_parameter') THEN 'parameter'
 WHEN language = 'go' THEN CASE WHEN node_kind = 'function_declaration' THEN 'function' WHEN node_kind = 'method_declaration' THEN 'method' WHEN node_kind IN ('type_declaration', 'type_spec', 'struct_type', 'interface_type') THEN 'type'
  WHEN node_kind = 'field_declaration' THEN 'field' WHEN node_kind IN ('const_declaration', 'const_spec') THEN 'constant' WHEN node_kind IN ('var_declaration', 'var_spec', 'short_var_declaration') THEN 'variable' WHEN node_kind IN ('import_declaration', 'import_spec') THEN 'import' WHEN node_kind = 'source_file' THEN 'module' END
 WHEN language = 'rust' THEN CASE WHEN node_kind IN ('function_item', 'function_signature_item') THEN 'function' WHEN node_kind IN ('struct_item', 'enum_item', 'trait_item', 'type_item', 'union_item') THEN 'type' WHEN node_kind = 'field_declaration' THEN 'field'
  WHEN node_kind IN ('const_item', 'static_item') THEN 'constant' WHEN node_kind = 'let_declaration' THEN 'variable' WHEN node_kind = 'use_declaration' THEN 'import' WHEN node_kind IN ('mod_item', 'source_file') THEN 'module' END
 WHEN language = 'python' THEN CASE node_kind WHEN 'function_definition' THEN 'function' WHEN 'class_definition' THEN 'type' WHEN 'import_statement' THEN 'import' WHEN 'import_from_statement' THEN 'import' WHEN 'module' THEN 'module' END
 WHEN language IN ('javascript', 'typescript') THEN CASE WHEN node_kind IN ('function_declaration', 'function_expression', 'arrow_function') OR language = 'typescript' AND node_kind = 'function_signature' THEN 'function'
  WHEN node_kind = 'method_definition' OR language = 'typescript' AND node_kind = 'method_signature' THEN 'method' WHEN node_kind IN ('class_declaration', 'class') OR language = 'typescript' AND node_kind IN ('abstract_class_declaration', 'interface_declaration', 'type_alias_declaration', 'enum_declaration') THEN 'type'
  WHEN node_kind = 'import_statement' THEN 'import' WHEN node_kind = 'program' THEN 'module' END
 WHEN language = 'java' THEN CASE WHEN node_kind = 'method_declaration' THEN 'method' WHEN node_kind IN ('class_declaration', 'interface_declaration', 'enum_declaration', 'record_declaration') THEN 'type' WHEN node_kind = 'import_declaration' THEN 'import' WHEN node_kind = 'program' THEN 'module' END
 WHEN language = 'c' THEN CASE WHEN node_kind IN ('function_definition', 'function_declarator') THEN 'function' WHEN node_kind IN ('struct_specifier', 'union_specifier', 'enum_specifier', 'type_definition') THEN 'type' WHEN node_kind = 'field_declaration' THEN 'field' WHEN node_kind = 'preproc_include' THEN 'import' WHEN node_kind = 'translation_unit' THEN 'module' END
 WHEN language = 'bash' THEN CASE node_kind WHEN 'function_definition' THEN 'function' WHEN 'program' THEN 'module' END END"""


@query(f"""SELECT {_CANONICAL_SQL} AS canonical, count(*) AS n
FROM (SELECT DISTINCT node_id, source_id, node_kind, CASE lower(regexp_extract(source_id, '\\.([^./]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'sh' THEN 'bash' END AS language FROM ast_nodes) GROUP BY 1""")
def ast_canonical(s, d):
    a = table(s, d, "ast_nodes").select("node_id", "source_id", "node_kind").distinct()
    return a.groupBy(K.canonical_kind(K.language_of(F.col("source_id")), F.col("node_kind")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT node_id, source_id, start_row FROM ast_nodes WHERE node_kind = 'class_declaration'")
def ast_kind_scan(s, d):
    return table(s, d, "ast_nodes").filter("node_kind = 'class_declaration'").select("node_id", "source_id", "start_row")


@query("SELECT DISTINCT node_id, json_extract(x, '$.severity')::BIGINT AS severity, x->>'$.message' AS message FROM (SELECT node_id, unnest(json_extract(diagnostics, '$[*]')) AS x FROM (SELECT DISTINCT node_id, diagnostics FROM lsp_symbols WHERE diagnostics IS NOT NULL AND diagnostics <> '' AND json_valid(diagnostics)))")
def lsp_diagnostics(s, d):
    return A.diagnostics(table(s, d, "lsp_symbols")).distinct()


@query("SELECT DISTINCT node_id, symbol_kind, detail, start_line, end_line FROM lsp_symbols WHERE node_id ILIKE (SELECT min(node_id)[1:20] FROM lsp_symbols) || '%'")
def lsp_symbols_of(s, d):
    t = table(s, d, "lsp_symbols")
    return A.symbols_of_file(t, t.agg(F.min("node_id")).first()[0][:20])


@query("SELECT id AS source_id FROM (SELECT DISTINCT id FROM source_files) WHERE id NOT IN (SELECT regexp_extract(node_id, '^(.*?\\.[A-Za-z]+)/', 1) FROM lsp_symbols)")
def lsp_needs_enrichment(s, d):
    return A.needs_enrichment(table(s, d, "source_files"), table(s, d, "lsp_symbols"))


# ---------------------------------------------------------------- joins over references and definitions


@query(f"""WITH {_DEFS}, used AS (SELECT DISTINCT token FROM node_refs WHERE container_node_id = (SELECT min(container_node_id) FROM node_refs))
SELECT DISTINCT token, node_id, source_id FROM defs WHERE token IN (SELECT token FROM used)""")
def refs_callees(s, d):
    r = table(s, d, "node_refs")
    return A.find_callees(r, _defs(s, d), r.agg(F.min("container_node_id")).first()[0])


@query(f"""WITH {_DEFS}, sites AS (SELECT container_node_id, token, count(*) AS n FROM node_refs WHERE container_node_id IS NOT NULL GROUP BY 1, 2)
SELECT container_node_id AS caller, d.node_id AS callee, sum(n)::BIGINT AS n_sites FROM sites JOIN (SELECT DISTINCT token, node_id FROM defs) d USING (token) GROUP BY 1, 2""")
def refs_call_edges(s, d):
    return A.call_edges(table(s, d, "node_refs"), _defs(s, d))


@query("""SELECT token, repository, part, list(node_id ORDER BY node_id) AS node_ids FROM (SELECT *, (row_number() OVER (PARTITION BY token, repository ORDER BY node_id) - 1) // 100 AS part
FROM (SELECT DISTINCT def_token AS token, node_id, split_part(node_id, '/', 1) AS repository FROM lsp_defs WHERE def_token IS NOT NULL AND node_id IS NOT NULL)) GROUP BY 1, 2, 3""")
def defs_token_map(s, d):
    return A.token_map(table(s, d, "lsp_defs").withColumnRenamed("def_token", "token"), per_row=100)


@query("SELECT container_node_id, count(*) AS n_refs, count(DISTINCT token) AS n_tokens FROM node_refs WHERE container_node_id IS NOT NULL GROUP BY 1")
def refs_fan_out(s, d):
    return A.fan_out(table(s, d, "node_refs"))


@query(f"WITH {_DEFS} SELECT token, node_id, source_id FROM defs WHERE token NOT IN (SELECT token FROM node_refs WHERE token IS NOT NULL)")
def defs_unreferenced(s, d):
    return A.unreferenced(_defs(s, d), table(s, d, "node_refs"))


@query(f"""WITH {_DEFS}, spans AS (SELECT DISTINCT node_id, source_id, node_kind, start_row, end_row, start_byte FROM ast_nodes)
SELECT token, node_id, source_id, coalesce(node_kind, '') AS node_kind, coalesce(start_row, 0) AS start_row, coalesce(end_row, 0) AS end_row, coalesce(start_byte, 0) AS start_byte, {_CLASS} AS kind FROM (SELECT DISTINCT token, node_id, source_id FROM defs) LEFT JOIN spans USING (node_id, source_id)""")
def defs_with_spans(s, d):
    return A.definitions_with_spans(_defs(s, d), table(s, d, "ast_nodes")).select("token", "node_id", "source_id", "node_kind", "start_row", "end_row", "start_byte", "kind")


@query(f"""WITH {_DEFS} SELECT * FROM (SELECT token, node_id, source_id, {_CLASS} AS kind FROM (SELECT DISTINCT token, node_id, source_id FROM defs) LEFT JOIN (SELECT DISTINCT node_id, source_id, node_kind FROM ast_nodes) USING (node_id, source_id)
WHERE token GLOB 'p*_[a-m]*' ORDER BY token, node_id LIMIT 100) WHERE kind = 'function'""")
def search_symbols(s, d):
    return A.search_symbols(_defs(s, d), table(s, d, "ast_nodes"), "p*_[a-m]*", "function", 100)


@query(f"""WITH {_DEFS}, t AS (SELECT token FROM defs GROUP BY token ORDER BY count(*) DESC, token LIMIT 1), sp AS (SELECT DISTINCT d.source_id, d.node_id, node_kind, {_CLASS} AS kind FROM defs d JOIN ast_nodes USING (node_id, source_id) WHERE token = (SELECT token FROM t))
SELECT (SELECT token FROM t) AS symbol, (SELECT count(*) FROM sp) AS n_definitions, (SELECT kind FROM sp ORDER BY source_id, node_id LIMIT 1) AS kind,
 (SELECT count(*) FROM node_refs WHERE token = (SELECT token FROM t) AND container_node_id IS NOT NULL) AS n_references, (SELECT count(DISTINCT container_node_id) FROM node_refs WHERE token = (SELECT token FROM t)) AS n_callers,
 (SELECT max(detail) FROM lsp_symbols WHERE node_id IN (SELECT node_id FROM sp)) AS hover, 'full' AS certainty""")
def inspect_symbol(s, d):
    defs = _defs(s, d)
    token = defs.groupBy("token").count().orderBy(F.desc("count"), "token").first()[0]
    return A.inspect_symbol(token, defs, table(s, d, "node_refs"), table(s, d, "ast_nodes"), table(s, d, "lsp_symbols"))


@query(f"""WITH RECURSIVE {_DEFS}, t AS (SELECT token FROM defs GROUP BY token ORDER BY count(*) DESC, token LIMIT 1),
edges AS (SELECT DISTINCT d.token AS owner, r.token FROM (SELECT DISTINCT container_node_id, token FROM node_refs WHERE container_node_id IS NOT NULL) r JOIN (SELECT DISTINCT token, node_id FROM defs) d ON d.node_id = r.container_node_id),
links AS (SELECT owner AS focal, token AS symbol, 0 AS side FROM edges WHERE token IN (SELECT token FROM defs) AND owner <> token UNION ALL SELECT token, owner, 1 FROM edges WHERE owner <> token),
ranked AS (SELECT focal, symbol FROM (SELECT focal, symbol, row_number() OVER (PARTITION BY focal ORDER BY side, symbol) AS k FROM links) WHERE k <= 8),
h1 AS (SELECT symbol FROM ranked WHERE focal = (SELECT token FROM t) GROUP BY symbol ORDER BY symbol LIMIT 25),
h2 AS (SELECT symbol FROM (SELECT symbol, min(focal) AS f FROM ranked WHERE focal IN (SELECT symbol FROM h1) GROUP BY 1) WHERE symbol NOT IN (SELECT symbol FROM h1) AND symbol <> (SELECT token FROM t) ORDER BY f, symbol LIMIT 25 - (SELECT count(*) FROM h1))
SELECT symbol, 1 AS hop FROM h1 UNION ALL SELECT symbol, 2 FROM h2""")
def inspect_neighborhood(s, d):
    defs = _defs(s, d)
    token = defs.groupBy("token").count().orderBy(F.desc("count"), "token").first()[0]
    return A.neighborhood(token, table(s, d, "node_refs"), defs, 2, 4, 25)


# ---------------------------------------------------------------- positions

_REF_SITES = "SELECT DISTINCT regexp_replace(regexp_replace(ref_uri, '^file://', ''), '^/', '') AS source_id, ref_start_line AS row, ref_start_col AS col, ref_token FROM lsp_refs"
_SMALLEST = """(n.start_row < p.row OR (n.start_row = p.row AND n.start_col <= p.col)) AND (n.end_row > p.row OR (n.end_row = p.row AND n.end_col >= p.col))"""


@query(f"""WITH p AS ({_REF_SITES}), n AS (SELECT DISTINCT node_id, source_id, node_kind, start_row, start_col, end_row, end_col, start_byte, end_byte FROM ast_nodes)
SELECT p.source_id, p.row, p.col, p.ref_token, n.node_id, n.node_kind FROM p JOIN n ON n.source_id = p.source_id AND {_SMALLEST}
QUALIFY row_number() OVER (PARTITION BY p.source_id, p.row, p.col, p.ref_token ORDER BY n.end_byte - n.start_byte, n.node_id) = 1""")
def position_referrers(s, d):
    return P.referrers(table(s, d, "lsp_refs"), table(s, d, "ast_nodes"))


@query(f"""WITH p AS (SELECT DISTINCT regexp_extract(node_id, '^(.*?\\.[A-Za-z]+)/', 1) AS source_id, start_line AS row, start_col AS col FROM lsp_symbols), n AS (SELECT DISTINCT node_id, source_id, start_row, start_col, end_row, end_col, start_byte, end_byte FROM ast_nodes),
hit AS (SELECT p.source_id, p.row, p.col, n.node_id FROM p JOIN n ON n.source_id = p.source_id AND {_SMALLEST} QUALIFY row_number() OVER (PARTITION BY p.source_id, p.row, p.col ORDER BY n.end_byte - n.start_byte, n.node_id) = 1)
SELECT p.source_id, p.row, p.col, coalesce(hit.node_id, '_lsp/' || p.row || ':' || p.col) AS node_id FROM p LEFT JOIN hit USING (source_id, row, col)""")
def position_symbols(s, d):
    return P.symbols_to_nodes(table(s, d, "lsp_symbols"), table(s, d, "ast_nodes"))


@query("""WITH f AS (SELECT min(source_id) AS source_id FROM ast_nodes WHERE node_kind = 'class_declaration')
SELECT node_id, node_kind FROM ast_nodes WHERE source_id = (SELECT source_id FROM f) AND start_row <= 9 AND (start_row < 9 OR start_col <= 4) AND (end_row > 9 OR (end_row = 9 AND end_col >= 4)) ORDER BY end_byte - start_byte, node_id LIMIT 1""")
def position_at(s, d):
    a = table(s, d, "ast_nodes")
    return P.node_at(a, a.filter("node_kind = 'class_declaration'").agg(F.min("source_id")).first()[0], 9, 4).select("node_id", "node_kind")


@query("""SELECT source_id, start_line, start_col, detail || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY source_id, detail ORDER BY start_line, start_col) AS n
FROM (SELECT DISTINCT regexp_extract(node_id, '^(.*?\\.[A-Za-z]+)/', 1) AS source_id, detail, start_line, start_col FROM lsp_symbols WHERE detail IS NOT NULL AND detail <> ''))""")
def lsp_discernible_ids(s, d):
    return P.discernible_ids(table(s, d, "lsp_symbols"))


# ---------------------------------------------------------------- chunk store

_MAN = "SELECT DISTINCT node_id, seq, chunk_hash, byte_offset, byte_len FROM content_manifest"


@query(f"""WITH m AS ({_MAN}), r AS (SELECT DISTINCT node_id, 100 AS lo, 900 AS hi FROM content_manifest)
SELECT node_id, lo, hi, seq, chunk_hash, greatest(lo - byte_offset, 0) AS from_byte, least(hi - byte_offset, byte_len) - greatest(lo - byte_offset, 0) AS n_bytes FROM r JOIN m USING (node_id) WHERE byte_offset < hi AND byte_offset + byte_len > lo""")
def chunk_ranges(s, d):
    m = table(s, d, "content_manifest")
    r = m.select("node_id").distinct().select("node_id", F.lit(100).alias("lo"), F.lit(900).alias("hi"))
    return C.read_ranges(m, r)


@query("""SELECT count(*) AS n_before, sum(g) AS n_gone, sum(1 - g) AS n_kept, sum(chunk_len) AS bytes_before, sum(chunk_len * g) AS bytes_gone FROM
 (SELECT chunk_hash, chunk_len, CASE WHEN chunk_hash IN (SELECT chunk_hash FROM content_manifest WHERE chunk_hash IS NOT NULL) THEN 0 ELSE 1 END AS g FROM (SELECT DISTINCT chunk_hash, chunk_len FROM content_chunks))""")
def chunk_gc(s, d):
    return C.collect_garbage(table(s, d, "content_chunks"), table(s, d, "content_manifest"))


@query("SELECT chunk_hash, chunk_len FROM (SELECT DISTINCT chunk_hash, chunk_len FROM content_chunks) c WHERE NOT EXISTS (SELECT 1 FROM content_manifest m WHERE m.chunk_hash = c.chunk_hash)")
def chunk_unreachable(s, d):
    return C.unreachable(table(s, d, "content_chunks"), table(s, d, "content_manifest"))


@query("""SELECT DISTINCT node_id, seq FROM content_manifest WHERE node_id NOT IN (SELECT id FROM (SELECT id, max(ingested_at) AS newest FROM source_files WHERE id IS NOT NULL GROUP BY 1) f
 LEFT JOIN (SELECT del_key, max(deleted_at) AS gone FROM deletions WHERE del_table = 'source_files' GROUP BY 1) g ON g.del_key = f.id WHERE g.gone IS NULL OR g.gone < f.newest)""")
def chunk_dead_manifests(s, d):
    """Entries of files that aren't there any more: never were, or were deleted since they last came in."""
    living = I.parent_keys(table(s, d, "source_files"), "id", table(s, d, "deletions"), "source_files").select(F.col("pk").alias("id"))
    return C.dead_manifests(table(s, d, "content_manifest"), living)


@query(f"""WITH m AS ({_MAN}) SELECT sum(byte_len) AS logical_bytes, count(*) AS n_refs, (SELECT sum(n) FROM (SELECT max(byte_len) AS n FROM m GROUP BY chunk_hash)) AS stored_bytes, (SELECT count(DISTINCT chunk_hash) + max(CASE WHEN chunk_hash IS NULL THEN 1 ELSE 0 END) FROM m) AS n_chunks,
 sum(byte_len) / (SELECT sum(n) FROM (SELECT max(byte_len) AS n FROM m GROUP BY chunk_hash)) AS ratio FROM m""")
def chunk_dedup(s, d):
    return C.dedup_ratio(table(s, d, "content_manifest"))


@query(f"""WITH m AS ({_MAN}), c AS (SELECT chunk_hash, max(hex(chunk_bytes)) AS x FROM content_chunks WHERE chunk_hash IS NOT NULL GROUP BY 1), j AS (SELECT m.*, c.x, row_number() OVER w - 1 AS k, coalesce(sum(byte_len) OVER (PARTITION BY node_id ORDER BY seq, byte_offset, byte_len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m LEFT JOIN c USING (chunk_hash) WINDOW w AS (PARTITION BY node_id ORDER BY seq, byte_offset, byte_len))
SELECT node_id, sum(byte_len)::BIGINT AS content_len, bool_and(x IS NOT NULL AND length(x) = 2 * byte_len AND k = seq AND before = byte_offset) AS complete, sha256(unhex(coalesce(string_agg(x, '' ORDER BY seq, byte_offset, byte_len), ''))) AS content_sha FROM j GROUP BY 1""")
def chunk_reconstruct(s, d):
    return C.reconstruct(table(s, d, "content_manifest"), table(s, d, "content_chunks"))


@query()
def chunk_cut(s, d):
    """Not SQL: a rolling hash over bytes; its test compares it with a byte-by-byte version."""
    return C.chunk(table(s, d, "source_files").dropDuplicates(["id", "content"])).drop("chunk_bytes")


@query()
def chunk_merkle(s, d):
    """Not SQL: a tree of pairwise hashes; its test compares it with a plain loop."""
    m = table(s, d, "content_manifest").filter("chunk_hash IS NOT NULL").select("node_id", "seq", "chunk_hash").distinct()
    return C.merkle_roots(m, "node_id", "seq", "chunk_hash")


@query()
def chunk_verify(s, d):
    """Not SQL: hashes of chunks cut here; the stored ones are keyed per repository. A sound store gives no rows."""
    return C.verify_blobs(C.store(C.chunk(table(s, d, "source_files"))))


# ---------------------------------------------------------------- extraction, folds, restriction keys, rules, versions


@query()
def extract_facts(s, d):
    """Not SQL: parsing; its tests pin rows per language."""
    return X.extract(table(s, d, "source_files"))


@query()
def extract_import_edges(s, d):
    f = X.extract(table(s, d, "source_files"))
    return N.resolve_imports(f.filter("what = 'ref'"), f.filter("what = 'import'"), f.filter("what = 'def'").withColumn("node_id", F.concat_ws(":", "source_id", "row"))).filter("via_import IS NOT NULL")


@query()
def ast_fold(s, d):
    """Not SQL: bottom-up folds; its test compares it with recursion."""
    return X.fold_hashes(table(s, d, "ast_nodes"))


@query("""WITH c AS (SELECT DISTINCT ON (node_id) node_id, regexp_replace(node_id, '/[^/]*$', '') AS container, start_byte FROM ast_nodes WHERE node_kind IN ('call_expression', 'call', 'method_invocation', 'command') ORDER BY node_id, start_byte)
SELECT container, node_id AS from_id, nxt AS to_id, 'fallthrough' AS edge_kind FROM (SELECT container, node_id, lead(node_id) OVER (PARTITION BY container ORDER BY start_byte, node_id) AS nxt FROM c) WHERE nxt IS NOT NULL""")
def cfg_fallthrough(s, d):
    return X.fallthrough_edges(table(s, d, "ast_nodes").filter(F.col("node_kind").isin("call_expression", "call", "method_invocation", "command")))


@query("""SELECT source_id, sha256(string_agg(r, chr(10) ORDER BY r)) AS restriction_key, count(*) AS n_targets FROM (SELECT DISTINCT source_id, coalesce(token, '') || chr(31) || coalesce(qualifier, '') AS r FROM node_refs WHERE source_id IS NOT NULL) GROUP BY 1""")
def restriction_keys(s, d):
    return G.restriction_keys(table(s, d, "node_refs"))


@query("""SELECT source_id, sha256(string_agg(h, '' ORDER BY h)) AS address FROM (SELECT DISTINCT source_id, sha256(token) AS h FROM node_refs WHERE token IS NOT NULL AND source_id IS NOT NULL) GROUP BY 1""")
def partition_addresses(s, d):
    return X.address(table(s, d, "node_refs").filter("token IS NOT NULL AND source_id IS NOT NULL"), ["source_id"], "token")


_LINES = r"WITH f AS (SELECT DISTINCT id, regexp_replace(decode(content), '\r\n', chr(10), 'g') AS t FROM source_files WHERE content IS NOT NULL), l AS (SELECT id AS source_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS row FROM f)"
_FOUND = """, found AS (SELECT 'unwrap_without_expect' AS rule_id, source_id, row FROM l WHERE source_id LIKE '%.rs' AND source_id NOT LIKE '%/tests/%' AND line LIKE '%.unwrap()%'
 UNION ALL SELECT 'sleep_in_tests', source_id, row FROM l WHERE source_id LIKE '%/tests/%' AND line LIKE '%sleep(%'
 UNION ALL SELECT 'merge_marker', source_id, row FROM l WHERE line LIKE '<<<<<<< %' OR line LIKE '>>>>>>> %'
 UNION ALL SELECT 'todo_without_owner', source_id, row FROM l WHERE line LIKE '%TODO: %')"""


def _findings(s, d):
    return R.findings(s, {"site_lines": R.site_lines(table(s, d, "source_files"))})


@query(_LINES + _FOUND + " SELECT rule_id, source_id, row AS start_row FROM found")
def rule_findings(s, d):
    return _findings(s, d).select("rule_id", "source_id", "start_row")


@query(_LINES + _FOUND + " SELECT rule_id, source_id, count(*) AS n, 1 AS allowed FROM found GROUP BY 1, 2 HAVING count(*) > 1")
def rule_baseline(s, d):
    f = _findings(s, d)
    return R.beyond_baseline(f, f.select("rule_id", "source_id").distinct().withColumn("count", F.lit(1)))


@query("""WITH lim AS (SELECT TIMESTAMP '2025-07-01' AS t), a AS (SELECT id, arg_max(size, mtime) AS size FROM nodes WHERE ingested_at < (SELECT t FROM lim) AND id IS NOT NULL GROUP BY 1), b AS (SELECT id, arg_max(size, mtime) AS size FROM nodes WHERE id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.size IS DISTINCT FROM b.size""")
def version_diff(s, d):
    n = table(s, d, "nodes").filter("id IS NOT NULL")
    last = lambda df: df.groupBy("id").agg(F.max_by("size", "mtime").alias("size"))
    return V.diff(last(n.filter(F.col("ingested_at") < F.lit("2025-07-01").cast("timestamp"))), last(n), "id", ["size"])


@query("""SELECT id, CASE WHEN kind = 0 AND length(id) % 5 = 0 THEN size + 1 ELSE size END AS size FROM (SELECT DISTINCT id, kind, size FROM nodes WHERE id IS NOT NULL) WHERE NOT (kind = 0 AND length(id) % 5 = 1)""")
def version_overlay(s, d):
    live = table(s, d, "nodes").filter("id IS NOT NULL").select("id", "kind", "size").distinct()
    keep = live.filter(~((F.col("kind") == 0) & F.pmod(F.length("id"), F.lit(5)).isin(0, 1)))
    files = live.filter((F.col("kind") == 0) & F.pmod(F.length("id"), F.lit(5)).isin(0, 1))
    shadow = files.select("id", "kind", (F.col("size") + 1).alias("size"), (F.pmod(F.length("id"), F.lit(5)) == 1).cast("int").alias("tombstone"))
    # rows of one id can differ here, so the overlay is keyed by the whole live row
    key = F.concat_ws("\x1f", "id", F.col("size").cast("string"))
    o = V.overlay(files.withColumn("k", key).select("k", "id", "kind", "size"), shadow.withColumn("k", F.concat_ws("\x1f", "id", (F.col("size") - 1).cast("string"))).select("k", "id", "kind", "size", "tombstone"), "k")
    return keep.select("id", "size").unionByName(o.select("id", "size"))


@query("""WITH r AS (SELECT min(id) AS old FROM nodes WHERE kind = 1 AND id LIKE '%/%' AND id NOT LIKE '%/%/%')
SELECT DISTINCT CASE WHEN id = old THEN 'moved/here' WHEN starts_with(id, old || '/') THEN 'moved/here' || id[length(old) + 1:] ELSE id END AS id, CASE WHEN parent_id = old THEN 'moved/here' WHEN starts_with(parent_id, old || '/') THEN 'moved/here' || parent_id[length(old) + 1:] ELSE parent_id END AS parent_id FROM nodes, r""")
def version_rename(s, d):
    n = table(s, d, "nodes")
    old = n.filter("kind = 1 AND id LIKE '%/%' AND id NOT LIKE '%/%/%'").agg(F.min("id")).first()[0]
    return V.rename_subtree(n, old, "moved/here").select("id", "parent_id").distinct()


@query("""WITH r AS (SELECT min(id) AS old FROM nodes WHERE kind = 1 AND id LIKE '%/%' AND id NOT LIKE '%/%/%') SELECT count(*) AS n FROM nodes, r WHERE id IS NULL OR NOT (id = old OR starts_with(id, old || '/'))""")
def version_remove(s, d):
    n = table(s, d, "nodes")
    old = n.filter("kind = 1 AND id LIKE '%/%' AND id NOT LIKE '%/%/%'").agg(F.min("id")).first()[0]
    return V.remove_subtree(n, old).agg(F.count(F.lit(1)).alias("n"))
