"""Queries over cell complexes of files, over what specifiers and positions mean, and over chunk lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import kinds as K
from lodestrata.operators import cells as C
from lodestrata.operators import facts as A
from lodestrata.operators import observations as O
from lodestrata.operators import projection as P
from lodestrata.operators import resolution as R
from lodestrata.plans.analytics import _TOKS
from lodestrata.plans.code import _DEFS
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


# ---------------------------------------------------------------- the complex of files: who refers to whom

_FILE = r"^(.*?\.[A-Za-z]+)/"
_EDGES = rf"e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT regexp_extract(node_id, '{_FILE}', 1) AS a, regexp_extract(referrer_node_id, '{_FILE}', 1) AS b FROM lsp_refs) WHERE a <> '' AND b <> '' AND a <> b)"
_STALKS = """k AS (SELECT source_id AS node, count(DISTINCT node_id) FILTER (node_kind IN ('function_declaration', 'function_definition', 'function_item', 'method_declaration', 'method_definition'))::DOUBLE AS x,
 count(DISTINCT node_id) FILTER (node_kind IN ('call_expression', 'call', 'method_invocation', 'command'))::DOUBLE AS y, count(DISTINCT node_id)::DOUBLE AS z FROM ast_nodes WHERE source_id IS NOT NULL GROUP BY 1)"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lsp_refs").select(F.regexp_extract("node_id", _FILE, 1).alias("a"), F.regexp_extract("referrer_node_id", _FILE, 1).alias("b"))
    return t.filter("a != '' AND b != '' AND a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stalks(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "ast_nodes").filter("source_id IS NOT NULL").select("source_id", "node_id", "node_kind").distinct()
    of = lambda *kinds: F.countDistinct(F.when(F.col("node_kind").isin(*kinds), F.col("node_id"))).cast("double")
    per = a.groupBy(F.col("source_id").alias("node")).agg(
        of("function_declaration", "function_definition", "function_item", "method_declaration", "method_definition").alias("x"), of("call_expression", "call", "method_invocation", "command").alias("y"), F.countDistinct("node_id").cast("double").alias("z")
    )
    return per.select("node", F.array("x", "y", "z").alias("stalk"))


@query(f"WITH {_EDGES}, {_STALKS} SELECT e.a, e.b, q.x - p.x AS d0, q.y - p.y AS d1 FROM e JOIN k p ON p.node = e.a JOIN k q ON q.node = e.b")
def cells_coboundary(s, d):
    """Over the first two of three coordinates."""
    delta = C.coboundary0(_edges(s, d), _stalks(s, d), C.project_range(3, 2))
    return delta.select("a", "b", F.col("delta")[0].alias("d0"), F.col("delta")[1].alias("d1"))


@query(f"WITH {_EDGES}, {_STALKS} SELECT e.a, e.b, 2 * (0.5 * q.x + 0.25 * q.z) - 2 * (0.5 * p.x + 0.25 * p.z) AS d FROM e JOIN k p ON p.node = e.a JOIN k q ON q.node = e.b")
def cells_weighted(s, d):
    """A weighted sum of coordinates, composed with a doubling."""
    m = C.compose(C.weighted(1, {0: 2.0}), C.weighted(3, {0: 0.5, 2: 0.25}))
    return C.coboundary0(_edges(s, d), _stalks(s, d), m).select("a", "b", F.col("delta")[0].alias("d"))


@query(f"""WITH {_EDGES}, u AS (SELECT a AS f, b AS t FROM e UNION ALL SELECT b, a FROM e),
three AS (SELECT p.f AS w, p.t AS x, q.t AS y, NULL AS z FROM u p JOIN u q ON q.f = p.t AND q.t > p.f JOIN u r ON r.f = q.t AND r.t = p.f WHERE p.f < p.t AND p.t < q.t),
four AS (SELECT p.f AS w, p.t AS x, q.t AS y, r.t AS z FROM u p JOIN u q ON q.f = p.t AND q.t > p.f JOIN u r ON r.f = q.t AND r.t > p.f AND r.t <> p.t JOIN u l ON l.f = r.t AND l.t = p.f WHERE p.f < p.t AND p.t < r.t)
SELECT * FROM three UNION ALL SELECT * FROM four""")
def cells_cycles(s, d):
    """Cycles of three and four files."""
    c = C.cycles(_edges(s, d), 4).select("cycle")
    return c.select(*[F.get("cycle", F.lit(i)).alias(n) for i, n in enumerate("wxyz")])


@query(f"""WITH {_EDGES}, {_STALKS}, u AS (SELECT a AS f, b AS t FROM e),
faces AS (SELECT p.f AS f1, p.t AS f2, q.t AS f3 FROM u p JOIN u q ON q.f = p.t JOIN u r ON r.f = p.f AND r.t = q.t)
SELECT count(*) AS n_faces, 0::BIGINT AS n_faults, coalesce(sum(abs(((j.x - i.x) + (l.x - j.x)) - (l.x - i.x))), 0)::DOUBLE AS total FROM faces JOIN k i ON i.node = f1 JOIN k j ON j.node = f2 JOIN k l ON l.node = f3""")
def cells_cochain(s, d):
    """Triangles of files that have stalks, and on how many of them the coboundary of the coboundary isn't zero."""
    e, k = _edges(s, d), _stalks(s, d)
    held = e.join(k.select(F.col("node").alias("a")), "a", "left_semi").join(k.select(F.col("node").alias("b")), "b", "left_semi")
    signed = C.signed_faces(C.cycles(held, 3))
    d1 = C.coboundary1(signed, C.coboundary0(held, k, C.project_dim(3, 0)))
    return d1.agg(F.count(F.lit(1)).alias("n_faces"), F.count_if(F.abs(F.col("delta")[0]) > 1e-4).alias("n_faults"), F.coalesce(F.sum(F.abs(F.col("delta")[0])), F.lit(0.0)).alias("total"))


@query(f"""WITH {_EDGES}, gone AS (SELECT DISTINCT del_key AS node FROM deletions WHERE del_table = 'source_files'), n AS (SELECT unnest([a, b]) AS node FROM e),
kept AS (SELECT DISTINCT node FROM n WHERE node NOT IN (SELECT node FROM gone WHERE node IS NOT NULL) UNION SELECT 'added'), old AS (SELECT a, b FROM e WHERE a NOT IN (SELECT node FROM gone WHERE node IS NOT NULL) AND b NOT IN (SELECT node FROM gone WHERE node IS NOT NULL))
SELECT 'node' AS what, node AS a, NULL AS b FROM kept UNION ALL SELECT 'edge', a, b FROM (SELECT a, b FROM old UNION SELECT 'added', min(node) FROM kept WHERE node <> 'added' HAVING count(*) > 0)""")
def cells_delta(s, d):
    """The complex after deleted files are removed and a node with one edge is added; one edge to nowhere is refused."""
    e = _edges(s, d)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    gone = table(s, d, "deletions").filter("del_table = 'source_files' AND del_key IS NOT NULL").select(F.col("del_key").alias("node"))
    first = nodes.join(gone, "node", "left_anti").agg(F.min("node").alias("b")).filter("b IS NOT NULL").select(F.lit("added").alias("a"), "b")
    new = s.createDataFrame([("added",)], "node string")
    kept, edges = C.apply_delta(nodes, e, gone, e.limit(0), new, first.unionByName(s.createDataFrame([("added", "nowhere")], "a string, b string")))
    return kept.select(F.lit("node").alias("what"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(edges.select(F.lit("edge").alias("what"), "a", "b"))


@query()
def cells_cycle_rank(s, d):
    return C.cycle_rank(_edges(s, d))


# ---------------------------------------------------------------- specifiers and regions

_LANG = "CASE lower(regexp_extract(source_id, '\\.([^./]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'sh' THEN 'bash' END"
_SPECS = f"""specs AS (SELECT DISTINCT split_part(source_id, '/', 1) AS repository, {_LANG} AS language, qualifier || '::' || token AS spec FROM node_refs WHERE qualifier IS NOT NULL AND token IS NOT NULL AND source_id IS NOT NULL),
s AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(trim(spec), '^(\\.\\.?/)+', ''), '[:/.]'), lambda p: p <> '') AS parts FROM specs),
exts AS (SELECT * FROM (VALUES ('go', ['go']), ('rust', ['rs']), ('python', ['py']), ('typescript', ['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs']), ('javascript', ['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs']), ('c', ['h', 'hpp', 'hh', 'c', 'cc', 'cpp', 'cxx'])) t(language, exts)),
x AS (SELECT s.repository, s.language, s.spec, s.parts, coalesce(exts.exts, []) AS exts, unnest(range(1, len(s.parts) + 1)) AS i FROM s LEFT JOIN exts USING (language) WHERE len(s.parts) > 0),
y AS (SELECT repository, language, spec, len(parts) - i AS back, unnest(range(1, len(exts) + 2)) AS k, parts[i] AS part, exts FROM x),
tried AS (SELECT repository, language, spec, back * 100 + k - 1 AS ord, CASE WHEN k <= len(exts) THEN part || '.' || exts[k] ELSE part END AS name, CASE WHEN back = 0 THEN CASE WHEN k <= len(exts) THEN 0.85 ELSE 0.8 END ELSE CASE WHEN k <= len(exts) THEN 0.7 ELSE 0.65 END END AS confidence FROM y
  UNION ALL SELECT repository, language, spec, 1000000, '|' || parts[len(parts)], 0.5 FROM s WHERE len(parts) > 0),
files AS (SELECT DISTINCT id, split_part(id, '/', 1) AS repository, regexp_extract(id, '([^/]*)$', 1) AS base FROM source_files WHERE id IS NOT NULL),
idx AS (SELECT repository, base AS name, id FROM files UNION ALL SELECT repository, '|' || regexp_replace(base, '\\.[^.]+$', ''), id FROM files WHERE regexp_matches(base, '^.+\\.[^.]+$')),
best AS (SELECT * FROM (SELECT DISTINCT t.* FROM tried t JOIN (SELECT DISTINCT repository, name FROM idx) i USING (repository, name)) QUALIFY row_number() OVER (PARTITION BY repository, language, spec ORDER BY ord, name) = 1),
resolved AS (SELECT b.repository, b.language, b.spec, i.id AS target, b.confidence::DOUBLE AS confidence FROM best b JOIN idx i USING (repository, name))"""


def _resolved(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "node_refs").filter("qualifier IS NOT NULL AND token IS NOT NULL AND source_id IS NOT NULL")
    specs = r.select(F.substring_index("source_id", "/", 1).alias("repository"), K.language_of(F.col("source_id")).alias("language"), F.concat_ws("::", "qualifier", "token").alias("spec"))
    return R.resolve_specifiers(specs, table(s, d, "source_files"))


@query(f"WITH {_SPECS} SELECT * FROM resolved")
def resolve_specifiers(s, d):
    """Files that qualified references mean, with confidence."""
    return _resolved(s, d)


@query(rf"""WITH j AS (SELECT DISTINCT regexp_extract(node_id, '{_FILE}', 1) AS a, regexp_extract(referrer_node_id, '{_FILE}', 1) AS b FROM lsp_refs), e AS (SELECT split_part(a, '/', 1) AS x, split_part(b, '/', 1) AS y, CASE WHEN a < b THEN 0.7 ELSE 0.85 END AS c FROM j WHERE a <> '' AND b <> '' AND a <> b)
SELECT least(x, y) AS a, greatest(x, y) AS b, least(1.0, avg(c))::DOUBLE AS confidence FROM e WHERE x <> y GROUP BY 1, 2""")
def region_confidence(s, d):
    """Mean confidence between repositories that refer to one another."""
    t = table(s, d, "lsp_refs").select(F.regexp_extract("node_id", _FILE, 1).alias("source"), F.regexp_extract("referrer_node_id", _FILE, 1).alias("target")).filter("source != '' AND target != '' AND source != target").distinct()
    e = t.withColumn("confidence", F.when(F.col("source") < F.col("target"), 0.7).otherwise(0.85))
    files = t.select(F.explode(F.array("source", "target")).alias("file")).distinct().withColumn("region", F.substring_index("file", "/", 1))
    return R.region_edges(e, files)


@query("SELECT split_part(id, '/', 1) AS region, len(string_split(id, '/')) - 1 AS depth, id AS path FROM (SELECT DISTINCT id FROM source_files WHERE id IS NOT NULL)")
def parse_order(s, d):
    return R.parse_order(table(s, d, "source_files"), F.substring_index("id", "/", 1))


@query("SELECT id AS node_id, max(ingested_at) AS priority FROM source_files WHERE id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 32")
def queue_drain(s, d):
    return R.drain(table(s, d, "source_files").filter("id IS NOT NULL").select(F.col("id").alias("node_id"), F.col("ingested_at").alias("priority")))


@query("""WITH v AS (SELECT id, arg_min(content, (ingested_at, content)) AS old, arg_max(content, (ingested_at, content)) AS new, count(*) AS n FROM source_files WHERE id IS NOT NULL AND content IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1),
r AS (SELECT 'never' AS policy, false AS skips, old <> new AS changed FROM v WHERE n > 1 UNION ALL SELECT 'length', octet_length(old) = octet_length(new), old <> new FROM v WHERE n > 1 UNION ALL SELECT 'content', old = new, old <> new FROM v WHERE n > 1)
SELECT policy, count(*) FILTER (skips AND changed) AS false_skips, count(*) FILTER (skips AND NOT changed) AS sound_skips FROM r GROUP BY 1""")
def policy_stats(s, d):
    """How often a review of a re-ingested file would be skipped, rightly or wrongly, by three policies."""
    v = table(s, d, "source_files").filter("id IS NOT NULL AND content IS NOT NULL AND ingested_at IS NOT NULL").groupBy("id").agg(F.min(F.struct("ingested_at", "content")).alias("old"), F.max(F.struct("ingested_at", "content")).alias("new"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same, changed = F.col("old.content") == F.col("new.content"), F.col("old.content") != F.col("new.content")
    by = {"never": F.lit(False), "length": F.octet_length("old.content") == F.octet_length("new.content"), "content": same}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), x.alias("skips"), changed.alias("changed")) for k, x in by.items()]))
    return R.policy_stats(v.select(rows.alias("r")).select("r.*"))


@query(f"""WITH {_TOKS}, t AS (SELECT max(created_at) AS latest FROM documents), e AS (SELECT toks.doc_id, d.created_at, unnest(m) AS x FROM toks JOIN documents d ON d.doc_id = toks.doc_id WHERE d.created_at IS NOT NULL)
SELECT p.x AS a, q.x AS b, sum(exp(-greatest(0, epoch_us(latest) / 1e6 - epoch_us(p.created_at) / 1e6) / 7776000.0)) AS weight FROM e p JOIN e q ON p.doc_id = q.doc_id AND p.x < q.x, t GROUP BY 1, 2""")
def coedit_decay(s, d):
    """Decayed weights of what one document mentions together, by the time since it was made."""
    docs = table(s, d, "documents")
    lists = docs.filter("text IS NOT NULL AND created_at IS NOT NULL").select("created_at", F.array_sort(F.array_distinct(O.mentions(F.col("text")))).alias("t")).filter(F.size("t") > 1)
    pairs = lists.select("created_at", "t", F.posexplode("t").alias("i", "a")).select("created_at", "a", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))
    return R.decayed(pairs, "created_at", docs.agg(F.max("created_at")).first()[0])


@query(r"""WITH r AS (SELECT DISTINCT node_id, regexp_replace(ref_uri, '^file:///?', '') AS source_id, ref_start_line AS line, ref_start_col AS col, ref_end_line AS end_line, ref_end_col AS end_col FROM lsp_refs WHERE ref_uri IS NOT NULL),
t AS (SELECT id AS source_id, string_split(TRY(decode(content)), E'\n') AS lines FROM (SELECT id, arg_max(content, (ingested_at, content)) AS content FROM source_files WHERE content IS NOT NULL AND id IS NOT NULL GROUP BY 1))
SELECT node_id, source_id, line, col, CASE WHEN line = end_line AND col <= end_col AND end_col <= length(lines[line + 1]) THEN substring(lines[line + 1], (col + 1)::BIGINT, (end_col - col)::BIGINT) END AS token,
 nullif(regexp_extract(substring(lines[line + 1], 1, col::BIGINT), '([A-Za-z0-9_]+)\.$', 1), '') AS qualifier FROM r JOIN t USING (source_id)""")
def lsp_reference_text(s, d):
    """Tokens and qualifiers at the places that references name."""
    return R.references_with_text(table(s, d, "lsp_refs"), table(s, d, "source_files"))


# ---------------------------------------------------------------- chunk lists

_STATE = """st AS (SELECT f.source_id, CASE WHEN m.chunked IS NULL THEN 'missing' WHEN m.chunked < f.written THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT id AS source_id, max(ingested_at) AS written FROM source_files WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY 1) f
 LEFT JOIN (SELECT node_id AS source_id, max(ingested_at) AS chunked FROM content_manifest WHERE node_id IS NOT NULL GROUP BY 1) m USING (source_id))"""


@query(f"WITH {_STATE} SELECT state, count(*) AS n FROM st GROUP BY 1")
def chunk_freshness(s, d):
    return R.manifest_freshness(table(s, d, "source_files"), table(s, d, "content_manifest")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STATE} SELECT * FROM st WHERE state <> 'fresh'")
def chunk_activation(s, d):
    return R.activation(table(s, d, "source_files"), table(s, d, "content_manifest"))


@query("""WITH m AS (SELECT DISTINCT node_id, seq, chunk_hash, byte_offset, byte_len FROM content_manifest WHERE node_id IS NOT NULL), e AS (SELECT *, coalesce(lag(byte_offset + byte_len) OVER (PARTITION BY node_id ORDER BY seq NULLS FIRST, byte_offset NULLS FIRST, chunk_hash NULLS FIRST), 0) AS expected FROM m),
c AS (SELECT chunk_hash, min(octet_length(chunk_bytes)) AS least, max(octet_length(chunk_bytes)) AS most, max(chunk_len) AS said FROM content_chunks GROUP BY 1)
SELECT node_id, seq, CASE WHEN said IS NULL AND least IS NULL THEN 'missing' WHEN coalesce(least <> most OR least <> said OR least <> byte_len, true) THEN 'length' WHEN byte_offset <> expected THEN 'gap' ELSE 'ok' END AS verdict FROM e LEFT JOIN c USING (chunk_hash)""")
def chunk_verified_pages(s, d):
    """What a verified read finds at every entry of the chunk lists."""
    return R.verified_pages(table(s, d, "content_manifest"), table(s, d, "content_chunks"))


# ---------------------------------------------------------------- single reads of the surface


def _some(s: SparkSession, d: str):
    """The smallest file with a record, and its parent."""
    r = table(s, d, "nodes").filter("record IS NOT NULL AND record != '' AND parent_id IS NOT NULL AND name IS NOT NULL").agg(F.min(F.struct("id", "parent_id", "name")).alias("r")).first()["r"]
    return r["id"], r["parent_id"], r["name"]


_SOME = "q AS (SELECT id, parent_id, name FROM nodes WHERE record IS NOT NULL AND record <> '' AND parent_id IS NOT NULL AND name IS NOT NULL ORDER BY id, parent_id, name LIMIT 1)"


@query(f"WITH {_SOME} SELECT DISTINCT n.id, n.record FROM nodes n JOIN q ON n.id = q.id WHERE n.record IS NOT NULL")
def nodes_read(s, d):
    return A.read_content(table(s, d, "nodes"), _some(s, d)[0])


@query(f"WITH {_SOME} SELECT DISTINCT n.id FROM nodes n JOIN q ON n.parent_id = q.parent_id AND n.name = q.name")
def nodes_lookup(s, d):
    _, parent, name = _some(s, d)
    return A.lookup_child(table(s, d, "nodes"), parent, name)


@query("SELECT n_nationkey, n_name, (SELECT count(*) > 7 FROM nation) AS truncated FROM nation ORDER BY n_nationkey LIMIT 7")
def sql_capped(s, d):
    """A statement's rows up to its cap, with the flag that there were more."""
    table(s, d, "nation").createOrReplaceTempView("nation_of_capped")
    rows, more = A.select_query(s, "SELECT n_nationkey, n_name FROM nation_of_capped ORDER BY n_nationkey", 7)
    return rows.withColumn("truncated", F.lit(more))


@query("SELECT CASE WHEN n <= 2 THEN n WHEN n <= 4 THEN 3 WHEN n <= 7 THEN 4 ELSE 5 END::INT AS bucket, count(*) AS n_parents FROM (SELECT parent_id, count(DISTINCT id) AS n FROM nodes WHERE parent_id <> '' GROUP BY 1) GROUP BY 1")
def kinds_arity(s, d):
    """Nodes by the bucket of their number of children."""
    per = table(s, d, "nodes").filter("parent_id != ''").groupBy("parent_id").agg(F.countDistinct("id").alias("n"))
    return per.groupBy(K.bucket_arity(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_parents"))


# ---------------------------------------------------------------- syntax rows, bundles, projections


@query("""WITH n AS (SELECT DISTINCT source_id, start_byte, end_byte, start_row, start_col, end_row, end_col FROM ast_nodes WHERE node_kind = 'function_definition' AND lower(source_id) LIKE '%.py' AND source_id IN (SELECT id FROM source_files WHERE content IS NOT NULL))
SELECT * FROM n""")
def ast_project(s, d):
    """Functions of Python files as parsed here, where the syntax table has nodes of the file."""
    files = table(s, d, "source_files")
    known = table(s, d, "ast_nodes").filter("node_kind = 'function_definition' AND source_id IS NOT NULL").select("source_id").distinct()
    return P.project_python(files).filter("node_kind = 'function_definition' AND lower(source_id) LIKE '%.py'").join(known, "source_id", "left_semi").select("source_id", "start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col").distinct()


@query(rf"""WITH {_DEFS}, t AS (SELECT token FROM defs GROUP BY token ORDER BY count(*) DESC, token LIMIT 1), own AS (SELECT DISTINCT token, node_id, source_id FROM defs WHERE token = (SELECT token FROM t)),
sp AS (SELECT node_id, source_id, any_value(node_kind) AS node_kind FROM ast_nodes GROUP BY 1, 2), used AS (SELECT DISTINCT token FROM node_refs WHERE container_node_id IN (SELECT node_id FROM own))
SELECT DISTINCT 'definitions' AS section, own.node_id, own.source_id, CASE WHEN node_kind IN ('function_declaration', 'function_item', 'function_definition') THEN 'function' WHEN node_kind = 'method_declaration' THEN 'method' ELSE 'unknown' END AS text FROM own LEFT JOIN sp USING (node_id, source_id)
UNION SELECT 'callers', container_node_id, source_id, NULL FROM node_refs WHERE token = (SELECT token FROM t) AND container_node_id IS NOT NULL
UNION SELECT 'callees', node_id, source_id, token FROM defs WHERE token IN (SELECT token FROM used)
UNION SELECT 'hover', node_id, NULL, detail FROM lsp_symbols WHERE trim(detail) <> '' AND node_id IN (SELECT node_id FROM own)
UNION SELECT 'freshness', node_id, NULL, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') FROM ast_nodes WHERE node_id IN (SELECT node_id FROM own) GROUP BY node_id""")
def inspect_sections(s, d):
    """The bundle of the symbol with the most definitions."""
    defs = A.node_defs(table(s, d, "lsp_symbols"), table(s, d, "ast_nodes"))
    token = defs.groupBy("token").count().orderBy(F.desc("count"), "token").first()[0]
    return P.symbol_sections(token, defs, table(s, d, "node_refs"), table(s, d, "ast_nodes"), table(s, d, "lsp_symbols"))


@query(f"""WITH {_TOKS}, t AS (SELECT x AS token FROM (SELECT unnest(m) AS x FROM toks) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
o AS (SELECT d.source, d.doc_id, [d.n_chars::DOUBLE, length(d.text)::DOUBLE / 2] AS v FROM documents d JOIN toks ON toks.doc_id = d.doc_id WHERE list_contains(m, (SELECT token FROM t)) AND d.lang = 'en' AND d.source IS NOT NULL AND d.n_chars IS NOT NULL),
l AS (SELECT source, arg_max(v, doc_id) AS v FROM o GROUP BY 1), f AS (SELECT source AS fs, v AS fv FROM l ORDER BY source LIMIT 1),
x AS (SELECT source, unnest([0, 1]) AS dim, v, fv FROM l, f WHERE source <> fs)
SELECT source, dim, v[dim + 1] - fv[dim + 1] AS delta, (v[dim + 1] - fv[dim + 1]) ** 2 AS severity FROM x WHERE abs(v[dim + 1] - fv[dim + 1]) > 1e-4""")
def obs_agreement_on(s, d):
    """Where sources differ in what they last said of the most mentioned token, in one language."""
    docs = table(s, d, "documents").filter("text IS NOT NULL").withColumn("m", O.mentions(F.col("text")))
    token = docs.select(F.explode("m").alias("x")).groupBy("x").count().orderBy(F.desc("count"), "x").first()
    obs = docs.filter("source IS NOT NULL AND n_chars IS NOT NULL").select("source", "doc_id", F.col("m").alias("mentions"), F.col("lang").alias("kind"), F.array(F.col("n_chars").cast("double"), F.length("text") / 2.0).alias("v"))
    return O.agreement_on(obs, token[0] if token else "", "en", "source", "doc_id", "v")[0]


@query()
def hv_simhash(s, d):
    """Not SQL: 512 normal planes from a seed; the test holds it against a plain product."""
    e = table(s, d, "embeddings")
    width = len(e.select("embedding").first()[0])
    return P.simhash(e.select("vec_id", "embedding"), "embedding", P.hyperplanes("semantic", width, 512)).select("vec_id", "hv")
