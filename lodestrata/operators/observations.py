"""Time-stamped observations: mentions in text, agreement of sources, co-occurrence, activity, high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters trimmed around a token, and the extensions of paths that count as mentions.
TRIMMED = ".,;:!?()[]'\"`"
EXTENSIONS = ("rs", "go", "py", "md", "toml", "capnp", "json", "yaml", "yml", "ts", "tsx", "js", "html", "hcl", "ex", "exs")
IS_MENTION = r"^(?:.+:sym:.+|sym:.+|bead:.+|commit:.+|[^/].*/.*\.(?:" + "|".join(EXTENSIONS) + r"))$"


def mentions(text: Column) -> Column:
    """Mentions in order of first appearance: symbol, bead and commit tags, and relative paths with a known extension."""
    toks = F.transform(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda t: F.btrim(t, F.lit(TRIMMED)))
    return F.array_distinct(F.filter(toks, lambda t: (t != "") & t.rlike("(?s)" + IS_MENTION)))


def latest_payloads(obs: DataFrame, by: list[str], at: str, payload: str) -> DataFrame:
    """The payload of the newest row per group; the greater payload among equal times."""
    return obs.groupBy(*by).agg(F.max(F.struct(at, payload)).alias("b")).select(*by, f"b.{at}", f"b.{payload}")


def agreement(payloads: DataFrame, source: str, vector: str, epsilon: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Star comparison with the first source by name: defects (source, dim, delta, severity) above epsilon, and coherence.

    payloads: one vector per source. Vectors of different lengths raise. The coherence is the sum of squared differences
    over all sources and components.
    """
    first = payloads.agg(F.min(F.struct(source, vector)).alias("f")).select(F.col(f"f.{source}").alias("first_source"), F.col(f"f.{vector}").alias("first_vector"))
    j = payloads.crossJoin(F.broadcast(first)).filter(F.col(source) != F.col("first_source"))  # one row
    same = F.when(F.size(vector) == F.size("first_vector"), F.zip_with(vector, "first_vector", lambda x, y: (x - y).cast("double"))).otherwise(F.raise_error(F.lit("payloads differ in length")).cast("array<double>"))
    d = j.select(source, F.posexplode(same).alias("dim", "delta"))
    return d.filter(F.abs("delta") > epsilon).select(source, "dim", "delta", (F.col("delta") * F.col("delta")).alias("severity")), d.agg(F.coalesce(F.sum(F.col("delta") * F.col("delta")), F.lit(0.0)).alias("coherence"))


def agreement_on(obs: DataFrame, token: str, kind: str, source: str, at: str, vector: str, epsilon: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """`agreement` of the newest payloads per source among the observations (mentions, kind, ...) of a kind that mention a
    token; rows without payload don't count."""
    held = obs.filter((F.col("kind") == kind) & F.array_contains("mentions", token) & F.col(vector).isNotNull())
    return agreement(latest_payloads(held, [source], at, vector).select(source, vector), source, vector, epsilon)


def activity(obs: DataFrame, key: str, tokens: str) -> DataFrame:
    """Share of observations that mention a token: token, n, rate."""
    total = obs.agg(F.count(F.lit(1)).alias("total"))
    n = obs.select(key, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("token", "n", (F.col("n") / F.col("total")).alias("rate"))  # one row


def cooccurrence(obs: DataFrame, source: str, tokens: str) -> DataFrame:
    """(a, b, n, n_sources, weight): pairs a < b that one observation mentions, and sum of ln(1 + n per source) times the
    share of sources. Pairs come from within one observation's own list, folded per source before the shuffle.

    A list of any length is whole: each token is paired with those behind it in a row of its own, so no row grows with
    the number of pairs.
    """
    lists = obs.select(source, F.array_sort(F.array_distinct(tokens)).alias("t")).filter(F.size("t") > 1)
    pairs = lists.select(source, "t", F.posexplode("t").alias("i", "a")).select(source, "a", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))
    per = pairs.groupBy("a", "b", source).agg(F.count(F.lit(1)).alias("n"))
    total = obs.select(source).distinct().agg(F.count(F.lit(1)).alias("total"))
    g = per.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"), F.sum(F.log1p("n")).alias("s"))
    return g.crossJoin(F.broadcast(total)).select("a", "b", "n", "n_sources", (F.col("s") * F.col("n_sources") / F.col("total")).alias("weight"))  # one row


def undirected_confidence(edges: DataFrame, a: str, b: str, confidence: str) -> DataFrame:
    """Mean confidence of undirected edges between different regions, held within 0 and 1."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), confidence)
    return e.groupBy("a", "b").agg(F.least(F.greatest(F.avg(confidence), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.count(F.lit(1)).alias("n"))


def above_mark(rows: DataFrame, at: str, mark) -> DataFrame:
    """Rows strictly newer than the high-water mark; older ones and equals are dropped for good."""
    return rows if mark is None else rows.filter(F.col(at) > F.lit(mark))


def ewma(events: DataFrame, key: str, at: str, hit: Column, alpha: float = 0.1) -> DataFrame:
    """Exponentially weighted rate per key in order of time: rate = (1 - alpha) * rate + alpha * hit, from 0.

    A fold over all events of a key would be one task's work, so days are folded first: of a day with n events the fold is
    (n, s), and two neighbours combine to (n1 + n2, s1 * (1 - alpha)^n2 + s2). A key's list has one entry per day.
    """
    from pyspark.sql import Window as W

    day = F.date_trunc("day", at)
    last = W.partitionBy(key, "_day").orderBy(F.desc(at), F.desc("_hit"))
    e = events.select(key, at, day.alias("_day"), hit.cast("double").alias("_hit")).withColumn("_age", F.row_number().over(last) - 1)
    per = e.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum(alpha * F.col("_hit") * F.pow(F.lit(1 - alpha), "_age")).alias("_s"))
    a = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_day", "_n", "_s"))).alias("_a"), F.sum("_n").alias("n"))
    return a.select(key, "n", F.aggregate("_a", F.lit(0.0), lambda s, x: s * F.pow(F.lit(1 - alpha), x["_n"]) + x["_s"]).alias("rate"))
