"""The relational surface that plain SQL statements reach: joins, sets, groupings, windows, recursion, functions, sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import facts as A
from lodestrata.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def both(name: str, sql: str, spark_sql: str | None = None):
    """A statement that runs as it is (or in Spark's own wording) through the read-only query operator."""

    def run(s, d, text=spark_sql or sql):
        for t in TABLES:
            table(s, d, t).createOrReplaceTempView(t)
        return A.read_only(s, text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = sql


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


both("sql_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
both("sql_shipping_priority", """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 50""")
both("sql_local_volume", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
both("sql_left_outer", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
both("sql_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS na, b.n AS nb FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
both("sql_semi_exists", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) GROUP BY 1")
both("sql_anti_exists", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("sql_theta_join", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
both("sql_set_operations", "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
both("sql_union_all", "SELECT 'c' AS src, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2")
both("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("sql_cube", "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
both("sql_having_filter", "SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 25) AS n_big, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10")
both("sql_windows", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS nxt,
first_value(o_orderkey) OVER w AS fst, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
both("sql_window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM events")
both("sql_percent_rank", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 9) AS cd FROM customer")
both("sql_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
both("sql_correlated", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT 1.02 * avg(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = part.p_brand)")
both("sql_strings", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 4) AS sub, length(c_name) AS n, replace(c_name, '#', '-') AS r, trim(c_mktsegment) AS t, concat(c_name, '/', c_mktsegment) AS c, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p, reverse(c_mktsegment) AS rev FROM customer",
     "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 4) AS sub, length(c_name) AS n, replace(c_name, '#', '-') AS r, trim(c_mktsegment) AS t, concat(c_name, '/', c_mktsegment) AS c, lpad(CAST(c_custkey AS STRING), 8, '0') AS p, reverse(c_mktsegment) AS rev FROM customer")
both("sql_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS mon, strftime(o_orderdate, '%Y-%m-%d') AS d, datediff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders",
     "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS mon, date_format(o_orderdate, 'yyyy-MM-dd') AS d, datediff(o_orderdate, TIMESTAMP '1992-01-01') AS days FROM orders")
both("sql_math", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, round(sqrt(abs(c_acctbal)), 6) AS s, sign(c_acctbal)::INT AS g, greatest(c_acctbal, 0) AS mx, least(c_acctbal, 0) AS mn, c_custkey % 7 AS md, round(ln(1 + abs(c_acctbal)), 6) AS l FROM customer",
     "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS s, CAST(sign(c_acctbal) AS INT) AS g, greatest(c_acctbal, 0D) AS mx, least(c_acctbal, 0D) AS mn, c_custkey % 7 AS md, round(ln(1 + abs(c_acctbal)), 6) AS l FROM customer")
both("sql_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events")
both("sql_json_each", "SELECT event_id, je.key AS k, je.value::VARCHAR AS v FROM events, json_each(props) je", "SELECT event_id, k, v FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS k, v")
both("sql_json_tree", "SELECT event_type, je.key AS k, count(*) AS n, count(DISTINCT je.value::VARCHAR) AS n_values FROM events, json_tree(props) je WHERE je.key IS NOT NULL GROUP BY 1, 2", "SELECT event_type, k, count(*) AS n, count(DISTINCT v) AS n_values FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS k, v GROUP BY 1, 2")
both("sql_map", "SELECT n_regionkey, cardinality(m) AS n, list_sort(map_keys(m)) AS ks, m['FRANCE'] AS france FROM (SELECT n_regionkey, map(list(n_name), list(n_nationkey)) AS m FROM nation GROUP BY 1)",
     "SELECT n_regionkey, size(m) AS n, sort_array(map_keys(m)) AS ks, try_element_at(m, 'FRANCE') AS france FROM (SELECT n_regionkey, map_from_entries(collect_list(struct(n_name, n_nationkey))) AS m FROM nation GROUP BY 1)")
both("sql_nulls_order", "SELECT doc_id, lang FROM documents ORDER BY lang NULLS FIRST, doc_id DESC LIMIT 40")
both("sql_nulls_last", "SELECT doc_id, source FROM documents ORDER BY source DESC NULLS LAST, doc_id LIMIT 40 OFFSET 3")
both("sql_nulls", "SELECT doc_id, coalesce(lang, '?') AS l, nullif(source, 'readme') AS s, CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size, TRY_CAST(path AS INTEGER) AS p FROM documents", "SELECT doc_id, coalesce(lang, '?') AS l, nullif(source, 'readme') AS s, CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size, TRY_CAST(path AS INT) AS p FROM documents")
both("sql_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY 1")
both("sql_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
both("sql_statistics", "SELECT event_type, count(*) AS n, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, min(value) AS mn, max(value) AS mx, round(corr(value, user_id), 6) AS co FROM events GROUP BY 1")
both("sql_median", "SELECT event_type, quantile_disc(user_id, 0.5) AS med, mode(user_id % 3) AS md FROM events WHERE user_id % 3 <> 1 OR event_id % 2 = 0 GROUP BY 1", "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY user_id) AS med, mode(user_id % 3) AS md FROM events WHERE user_id % 3 <> 1 OR event_id % 2 = 0 GROUP BY 1")
both("sql_unnest", "SELECT vec_id, count(*) AS n, round(sum(x), 4) AS s FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1", "SELECT vec_id, count(*) AS n, round(sum(x), 4) AS s FROM (SELECT vec_id, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW explode(embedding) t AS x) GROUP BY 1")


@query("SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F', 'O', 'P'))")
def frame_pivot(s, d):
    o = table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return o


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def window_tumbling(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY 1""")
def window_sliding(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""")
def window_session(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""")
def join_as_of(s, d):
    """As-of join without pairs: a running maximum within each user's day, and the last purchase of earlier days from one
    row per user and day, so that the events of a busy user are many days' tasks and not one."""
    e = table(s, d, "events").filter("event_type IN ('purchase', 'error')").select("event_id", "user_id", "ts", "event_type", F.date_trunc("day", "ts").alias("day"))
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    within = W.partitionBy("user_id", "day").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = e.groupBy("user_id", "day").agg(F.max(bought).alias("last")).select("user_id", "day", F.max("last").over(before).alias("earlier"))
    j = e.withColumn("p", F.max(bought).over(within)).filter("event_type = 'error'").join(days, ["user_id", "day"])
    return j.select("event_id", F.coalesce("p", "earlier").alias("p")).filter("p IS NOT NULL").select("event_id", F.col("p.event_id").alias("last_purchase"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_k_per_key(s, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")
