"""Full-text search: BM25 over token tables, for one query or a set of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): ASCII words in lower case. Counted within the row, so a long text is one pass without a shuffle."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9_]+"), lambda w: w != "")
    return docs.filter(F.col(text).isNotNull()).select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, item, score, rank): the k best documents of every query (columns query, q_text), ties by smaller key.

    Words that no query has are dropped before they are counted, so their postings are never shuffled.
    Empty queries and k = 0 have no results.
    """
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9_]+"), lambda w: w != "")
    cut = docs.filter(F.col(text).isNotNull()).select(key, words.alias("_w"))
    stats = cut.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("_w")).alias("avg_len"))
    wanted = queries.select("query", F.explode(F.array_distinct(F.filter(F.split(F.lower("q_text"), "[^a-z0-9_]+"), lambda w: w != ""))).alias("term"))
    # the length travels with the words that are wanted, so lengths of all documents never do
    occurring = cut.select(key, F.size("_w").alias("len"), F.explode("_w").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    hit = occurring.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    j = hit.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = j.select(key, "term", w.alias("w")).join(wanted, "term").groupBy("query", F.col(key).alias("item")).agg(F.sum("w").alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item"))).filter(F.col("rank") <= k)
