"""Queries over vectors, hypervectors, texts, observations and cell complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.patterns import topic_matches
from lodestrata.operators import graphs as G
from lodestrata.operators import hypervectors as H
from lodestrata.operators import observations as O
from lodestrata.operators import textsearch as T
from lodestrata.operators import vectors as V
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


# ---------------------------------------------------------------- hypervectors: signs of the embeddings, 64 bits


def _signs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", H.sign_words(F.col("embedding"), 64).alias("hv"))


_BITS = "signs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"
_DIST = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {a}.bits[i] <> {b}.bits[i] THEN 1 ELSE 0 END))::INT"


@query(f"WITH {_BITS}, q AS (SELECT bits FROM signs WHERE vec_id = (SELECT min(vec_id) FROM signs)) SELECT * FROM (SELECT vec_id, {_DIST.format(a='signs', b='q')} AS distance FROM signs, q) WHERE distance <= 30 ORDER BY distance, vec_id LIMIT 20")
def hv_radius(s, d):
    h = _signs(s, d)
    return H.radius_top_k(h, h.orderBy("vec_id").first()["hv"], "hv", "vec_id", 30, 20)


@query(f"WITH {_BITS}, q AS (SELECT bits FROM signs WHERE vec_id = (SELECT min(vec_id) FROM signs)) SELECT count(*) AS n FROM signs, q WHERE {_DIST.format(a='signs', b='q')} <= 28")
def hv_density(s, d):
    h = _signs(s, d)
    return H.density(h, h.orderBy("vec_id").first()["hv"], "hv", 28)


@query(f"WITH {_BITS}, c AS (SELECT label, i, sum(bits[i]) AS n FROM signs, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, sum(n % 2)::BIGINT AS n_set FROM c GROUP BY 1")
def hv_bundle(s, d):
    return H.bundle(_signs(s, d), ["label"], "hv").select("label", F.aggregate("hv", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)).alias("n_set"))


@query(f"WITH {_BITS}, c AS (SELECT label, i, sum(bits[i]) AS n, count(*) AS t FROM signs, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, count(*) FILTER (n > t // 2) AS n_set FROM c GROUP BY 1")
def hv_majority(s, d):
    return H.bundle_majority(_signs(s, d), ["label"], "hv").select("label", F.aggregate("hv", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)).alias("n_set"))


@query()
def hv_calibrate(s, d):
    """Not SQL: pairs drawn by a generator; its test repeats the draw."""
    return H.calibrate(_signs(s, d), "hv", "vec_id")


@query()
def hv_combined(s, d):
    """Not SQL: rotations of bit vectors; its test compares them with integers of arbitrary length."""
    layers = F.array(*[F.lit(x) for x in H.LAYERS])
    e = _signs(s, d).select(F.col("label").cast("string").alias("scope"), F.get(layers, F.pmod(F.col("vec_id"), F.lit(7)).cast("int")).alias("layer"), "hv")
    return H.combined(H.bundle(e, ["scope", "layer"], "hv"), "scope", "layer", "hv")


@query(f"""WITH {_BITS}, p AS (SELECT a.label, {_DIST.format(a='a', b='b')} AS dist FROM signs a JOIN signs b ON a.label = b.label AND a.vec_id < b.vec_id), m AS (SELECT label, quantile_disc(dist, 0.5)::BIGINT AS median, count(*) AS sample_size FROM p GROUP BY 1)
SELECT m.label, median, sample_size, quantile_disc(abs(dist - median), 0.5)::BIGINT AS mad FROM p JOIN m USING (label) GROUP BY 1, 2, 3""")
def hv_baseline_all(s, d):
    return H.median_and_mad_of_counts(H.pair_distances(_signs(s, d), "hv", "vec_id", "label"), "label")


@query(f"""WITH RECURSIVE {_BITS}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM signs a JOIN signs b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DIST.format(a='a', b='b')} <= 31),
u AS (SELECT a AS f, b AS t FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT vec_id AS node, vec_id AS seen FROM signs UNION SELECT r.node, u.t FROM r JOIN u ON u.f = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def hv_clusters_all(s, d):
    h = _signs(s, d)
    return G.consistency(H.radius_edges(h, "hv", "vec_id", "label", 31), h.select(F.col("vec_id").alias("node")), 32)


# ---------------------------------------------------------------- dense vectors

_D2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE) ** 2)))"


@query(f"SELECT query, neighbour, round(distance, 6) AS distance, rank FROM (SELECT q.vec_id AS query, r.vec_id AS neighbour, {_D2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, r.vec_id)::INT AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id) WHERE rank <= 10")
def knn_l2(s, d):
    e = table(s, d, "embeddings")
    return V.knn(e.filter("vec_id % 20 = 0"), e, 10).withColumn("distance", F.round("distance", 6))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"


@query(f"SELECT query, neighbour, rank FROM (SELECT q.vec_id AS query, r.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {_COS}, r.vec_id)::INT AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id) WHERE rank <= 10")
def knn_cosine(s, d):
    e = table(s, d, "embeddings")
    return V.knn(e.filter("vec_id % 20 = 0"), e, 10, metric="cosine").select("query", "neighbour", "rank")


def _two_rankings(s, d):
    e = table(s, d, "embeddings")
    a = V.knn(e.filter("vec_id % 20 = 0"), e, 10).select("query", F.col("neighbour").alias("item"), "rank", "distance")
    b = V.knn(e.filter("vec_id % 20 = 0"), e, 10, metric="cosine").select("query", F.col("neighbour").alias("item"), "rank", "distance")
    return e, a, b


_RANKS = f"""ra AS (SELECT query, item, rank FROM (SELECT q.vec_id AS query, r.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id) WHERE rank <= 10),
rb AS (SELECT query, item, rank FROM (SELECT q.vec_id AS query, r.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {_COS}, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id) WHERE rank <= 10),
rel AS (SELECT q.vec_id AS query, r.vec_id AS item FROM embeddings q JOIN embeddings r ON q.label = r.label AND q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)"""


@query(f"WITH {_RANKS} SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY 1, 2")
def fuse_rrf(s, d):
    _, a, b = _two_rankings(s, d)
    return V.rrf([a, b]).select("query", "item", F.round("score", 9).alias("score"))


@query(f"WITH {_RANKS} SELECT round((SELECT avg(r) FROM (SELECT rel.query, count(ra.item) / count(*)::DOUBLE AS r FROM rel LEFT JOIN ra USING (query, item) GROUP BY 1)), 9) AS recall, round((SELECT avg(j) FROM (SELECT query, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*)::DOUBLE AS j FROM (SELECT query, item, ra.rank AS x, rb.rank AS y FROM ra FULL JOIN rb USING (query, item)) GROUP BY 1)), 9) AS jaccard")
def rank_metrics(s, d):
    e, a, b = _two_rankings(s, d)
    rel = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label").join(e.select(F.col("vec_id").alias("item"), "label"), "label").filter("query != item").select("query", "item")
    return V.recall_at_k(a, rel, 10).crossJoin(V.jaccard_at_k(a, b, 10)).select(F.round("recall", 9).alias("recall"), F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH {_RANKS}, g AS (SELECT query, sum(1 / log2(rank + 1.0)) AS dcg FROM ra JOIN rel USING (query, item) GROUP BY 1), n AS (SELECT query, count(*) AS n FROM rel GROUP BY 1) SELECT round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0)))), 9) AS ndcg FROM n LEFT JOIN g USING (query)")
def rank_ndcg(s, d):
    e, a, _ = _two_rankings(s, d)
    rel = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label").join(e.select(F.col("vec_id").alias("item"), "label"), "label").filter("query != item").select("query", "item")
    return V.ndcg_at_k(a, rel, 10).select(F.round("ndcg", 9).alias("ndcg"))


@query("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n)::DOUBLE AS t FROM n)
SELECT round(sum(n / t * ln(n * t / (nx * ny))), 9) AS mi FROM n JOIN (SELECT lang, sum(n)::DOUBLE AS nx FROM n GROUP BY 1) USING (lang) JOIN (SELECT source, sum(n)::DOUBLE AS ny FROM n GROUP BY 1) USING (source), t""")
def rank_mutual_information(s, d):
    docs = table(s, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    return V.mutual_information(docs, "lang", "source").select(F.round("mi", 9).alias("mi"))


@query("""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM docs),
q(query, term) AS (VALUES ('lock', 'writer'), ('lock', 'lock'), ('lock', 'waits'), ('cache', 'stale'), ('cache', 'digest'), ('cache', 'cache')),
p AS (SELECT doc_id, len(w) AS len, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
sc AS (SELECT query, doc_id AS item, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM p JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)
SELECT query, item, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) <= 10""")
def text_search(s, d):
    q = s.createDataFrame([("lock", "Writer lock waits"), ("cache", "stale digest cache")], "query string, q_text string")
    return T.search(table(s, d, "documents"), q).select("query", "item", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- observations: the documents are observations of sources

_MENTION = """^(?:.+:sym:.+|sym:.+|bead:.+|commit:.+|[^/].*/.*\\.(?:rs|go|py|md|toml|capnp|json|yaml|yml|ts|tsx|js|html|hcl|ex|exs))$"""
_TOKS = "toks AS (SELECT doc_id, source, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: trim(x, '.,;:!?()[]''\"`')), lambda x: x <> '' AND regexp_full_match(x, '" + _MENTION + "', 's'))) AS m FROM documents WHERE text IS NOT NULL)"


def _observed(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", O.mentions(F.col("text")).alias("m"))


@query(f"WITH {_TOKS} SELECT m AS token, count(*) AS n FROM (SELECT unnest(m) AS m FROM toks) GROUP BY 1")
def obs_mentions(s, d):
    return _observed(s, d).select(F.explode("m").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOKS} SELECT token, count(*) AS n, count(*) / (SELECT count(*) FROM toks)::DOUBLE AS rate FROM (SELECT unnest(m) AS token FROM toks) GROUP BY 1")
def obs_activity(s, d):
    return O.activity(_observed(s, d), "doc_id", "m")


@query(f"""WITH {_TOKS}, e AS (SELECT doc_id, source, unnest(m) AS t FROM toks), p AS (SELECT a.t AS a, b.t AS b, a.source, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.t < b.t GROUP BY 1, 2, 3)
SELECT a, b, sum(n)::BIGINT AS n, count(*) AS n_sources, round(sum(ln(1 + n)) * count(*) / (SELECT count(*) FROM (SELECT DISTINCT source FROM toks)), 9) AS weight FROM p GROUP BY 1, 2""")
def obs_cooccurrence(s, d):
    return O.cooccurrence(_observed(s, d), "source", "m").withColumn("weight", F.round("weight", 9))


_LATEST = "latest AS (SELECT label::VARCHAR AS source, arg_max(embedding, vec_id) AS v FROM embeddings GROUP BY 1), f AS (SELECT source AS fs, v AS fv FROM latest ORDER BY source LIMIT 1)"


@query(f"WITH {_LATEST}, d AS (SELECT source, i - 1 AS dim, (v[i] - fv[i])::DOUBLE AS delta FROM latest, f, range(1, 65) r(i) WHERE source <> fs) SELECT source, dim::INT AS dim, delta, delta * delta AS severity FROM d WHERE abs(delta) > 1e-4")
def obs_agreement(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("string").alias("source"), "vec_id", F.col("embedding").alias("v"))
    return O.agreement(O.latest_payloads(e, ["source"], "vec_id", "v"), "source", "v")[0]


@query(f"WITH {_LATEST}, d AS (SELECT (v[i] - fv[i])::DOUBLE AS delta FROM latest, f, range(1, 65) r(i) WHERE source <> fs) SELECT round(sum(delta * delta), 6) AS coherence FROM d")
def obs_coherence(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("string").alias("source"), "vec_id", F.col("embedding").alias("v"))
    return O.agreement(O.latest_payloads(e, ["source"], "vec_id", "v"), "source", "v")[1].select(F.round("coherence", 6).alias("coherence"))


@query("""SELECT user_id, count(*) AS n, round(sum(0.1 * CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END * power(0.9, age)), 9) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_type = 'purchase') DESC) - 1 AS age FROM events) GROUP BY 1""")
def obs_ewma(s, d):
    return O.ewma(table(s, d, "events"), "user_id", "ts", F.col("event_type") == "purchase").withColumn("rate", F.round("rate", 9))


@query("SELECT least(repo, source) AS a, greatest(repo, source) AS b, least(greatest(avg(n_chars / 1000.0), 0), 1) AS confidence, count(*) AS n FROM documents WHERE repo <> source AND n_chars IS NOT NULL GROUP BY 1, 2")
def obs_confidence(s, d):
    e = table(s, d, "documents").filter("n_chars IS NOT NULL").select("repo", "source", (F.col("n_chars") / 1000.0).alias("c"))
    return O.undirected_confidence(e, "repo", "source", "c")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def obs_above_mark(s, d):
    e = table(s, d, "events")
    return O.above_mark(e, "ts", e.agg(F.expr("max(ts) - INTERVAL 3 DAY")).first()[0]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, 'app.' || event_type || '.u' || user_id AS topic FROM events) WHERE regexp_matches(topic, '^app\\.[^.]*\\.u1[0-9]*$') AND topic LIKE 'app.%.u1%' AND split_part(topic, '.', 3) = 'u1'")
def obs_topics(s, d):
    e = table(s, d, "events").withColumn("topic", F.concat(F.lit("app."), "event_type", F.lit(".u"), F.col("user_id").cast("string")))
    return e.filter(topic_matches(F.col("topic"), "app.*.u1")).select("event_id")


# ---------------------------------------------------------------- cell complexes: neighbouring embeddings are joined


def _edges(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2")), "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


def _stalks(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("stalk"))


_DELTA = "delta AS (SELECT a.vec_id AS a, b.vec_id AS b, list_transform(range(1, 65), lambda i: (b.embedding[i] - a.embedding[i])::DOUBLE) AS delta FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"WITH {_DELTA} SELECT a, b, round(list_sum(list_transform(delta, lambda x: x * x)), 6) AS defect FROM delta")
def sheaf_defects(s, d):
    return G.defects(G.coboundary(_edges(s, d), _stalks(s, d))).withColumn("defect", F.round("defect", 6))


@query(f"WITH {_DELTA}, v AS (SELECT a, b, i - 1 AS dim, delta[i] AS value FROM delta, range(1, 65) r(i)) SELECT a, count(*) AS n, round(max(abs(value)), 6) AS worst FROM v WHERE abs(value) > 1e-4 GROUP BY 1")
def sheaf_violations(s, d):
    v = G.violations(G.coboundary(_edges(s, d), _stalks(s, d)))
    return v.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("value")), 6).alias("worst"))


@query(f"""WITH RECURSIVE {_DELTA}, e AS (SELECT a, b FROM delta WHERE list_sum(list_transform(delta, lambda x: x * x)) < (SELECT median(list_sum(list_transform(delta, lambda x: x * x))) FROM delta)), u AS (SELECT a AS f, b AS t FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, u.t FROM r JOIN u ON u.f = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def sheaf_consistency(s, d):
    df = G.defects(G.coboundary(_edges(s, d), _stalks(s, d)))
    return G.consistency(df, _stalks(s, d), df.agg(F.median("defect")).first()[0])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT least(user_id, event_id) AS a, greatest(user_id, event_id) AS b FROM events), u AS (SELECT a AS f, b AS t FROM e UNION SELECT b, a FROM e),
r AS (SELECT (SELECT min(a) FROM e) AS node, 0 AS depth UNION SELECT u.t, r.depth + 1 FROM r JOIN u ON u.f = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def graph_bfs_all(s, d):
    e = table(s, d, "events").select(F.least("user_id", "event_id").alias("a"), F.greatest("user_id", "event_id").alias("b")).distinct()
    return G.bfs(e, e.agg(F.min("a").alias("node")), 3)


@query("""WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT x.a AS x, x.b AS y, z.b AS z FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b""")
def graph_triangles_all(s, d):
    return G.triangles(table(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, -1 - o_orderkey AS b FROM orders), u AS (SELECT a AS f, b AS t FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT f AS node FROM u), r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, u.t FROM r JOIN u ON u.f = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def graph_components_all(s, d):
    return G.components(table(s, d, "orders").select(F.col("o_custkey").alias("a"), (-1 - F.col("o_orderkey")).alias("b")))


@query("SELECT DISTINCT repo AS region FROM (SELECT DISTINCT repo, path AS file FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL) WHERE file IN (SELECT path FROM documents WHERE source = 'incident_notes' AND path IS NOT NULL)")
def sheaf_touched_regions(s, d):
    docs = table(s, d, "documents").filter("path IS NOT NULL")
    regions = docs.filter("repo IS NOT NULL").select(F.col("repo").alias("region"), F.concat("path", F.lit(":sym:x")).alias("label")).distinct()
    return G.touched_regions(regions, docs.filter("source = 'incident_notes'").select(F.col("path").alias("file")))


@query(f"WITH {_DELTA}, v AS (SELECT max(abs(delta[i])) AS worst FROM delta, range(1, 65) r(i)) SELECT round(worst, 6) AS worst, (SELECT count(*) FROM embeddings) AS n_cells, CASE WHEN worst < 0.1 THEN 'per-node' ELSE 'per-file' END AS granularity, (SELECT count(*) FROM embeddings) >= 8 AS distributed FROM v")
def sheaf_granularity(s, d):
    g = G.granularity(G.violations(G.coboundary(_edges(s, d), _stalks(s, d))), _stalks(s, d))
    return g.withColumn("worst", F.round("worst", 6))


@query("SELECT round(avg(1 / (1 + var * 2.0)), 6) AS mean_weight, count(*) AS n_dims FROM (SELECT i, var_pop(embedding[i]::DOUBLE) AS var FROM embeddings, range(1, 65) r(i) GROUP BY 1)")
def sheaf_learned_weights(s, d):
    v = table(s, d, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("var"))
    return v.agg(F.round(F.avg(1 / (1 + F.col("var") * 2.0)), 6).alias("mean_weight"), F.count(F.lit(1)).alias("n_dims"))
