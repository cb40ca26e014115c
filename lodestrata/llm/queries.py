"""Queries of the operators for training text, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import docpairs, mixing, provenance, syntax, tokens, toxicity
from lodestrata.session import table


def stamp(spark: SparkSession, path: str) -> tuple:
    """The path of a table with the size and time of what lies there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    at, size = fs.getFileStatus(p), fs.getContentSummary(p)
    return path, at.getModificationTime(), size.getLength(), size.getFileCount()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods with documentation that tells something."""
    return docpairs.documented_functions(table(spark, d, "source_files"), table(spark, d, "ast_nodes")).select("node_id").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Their code, description and signature."""
    return docpairs.pairs(table(spark, d, "source_files"), table(spark, d, "ast_nodes"), table(spark, d, "lsp_symbols"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files nobody wrote by hand here."""
    return provenance.classify(table(spark, d, "source_files")).filter("label != 'handwritten'").select("source_id")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and label."""
    return provenance.classify(table(spark, d, "source_files")).groupBy(F.substring_index("source_id", "/", 1).alias("repository"), "label").agg(F.count(F.lit(1)).alias("n_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that no dialect of their language derives."""
    return syntax.broken(table(spark, d, "source_files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of broken files per repository and language."""
    return syntax.rates(table(spark, d, "source_files"), table(spark, d, "file_errors"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document's text."""
    return tokens.encode(table(spark, d, "documents"))


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source."""
    docs = table(spark, d, "documents")
    counted = tokens.encode(docs.select(F.struct("doc_id", "source").alias("k"), "text"), key="k", ids=False)
    return counted.groupBy(F.col("k.source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source really holds."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


_MODELS: dict[tuple, toxicity.Model] = {}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores by the one model of these tables: it is fitted again only if a file of theirs changes."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "review_labels")
    key = (spark.sparkContext.applicationId, *[stamp(spark, f"{d}/{n}.parquet") for n in ("documents", "review_labels")])
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = toxicity.fit(docs, labels)
    return toxicity.score(docs, _MODELS[key])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, d).filter("flagged").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return toxicity.rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_labels, p5_found, p5_rates, p7_ids, p7_lengths, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}

#: none of these can be stated in SQL (grammars, message passing, byte-pair merges, quotas, a trained model); their tests
#: hold them against brute force, reference encoders, exact rules or held-out labels
ORACLES: dict[str, str] = {}
