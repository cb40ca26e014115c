"""Source files that do not parse: a verdict per file, rates per repository and language."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.grammars import EXTENSIONS, REPORTED, parse

# Spellings of languages that files without a known extension may declare.
SPELLINGS = {"go": "go", "golang": "go", "rust": "rust", "rs": "rust", "python": "python", "py": "python", "python3": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "java": "java", "c": "c", "h": "header", "c++": "cpp", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "jsx": "javascript", "node": "javascript", "tsx": "tsx", "typescriptreact": "tsx", "javascriptreact": "javascript", "bash": "bash", "sh": "bash", "shell": "bash", "zsh": "bash"}


def _lookup(col, table: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col]


def verdicts(files: DataFrame) -> DataFrame:
    """(source_id, repository, language, valid, reason) of every row with id and content.

    The language is that of the file's extension, else of the column `language`; valid is NULL where there is no grammar.
    A file is valid if at least one dialect of its language derives all of it (a `.h` file one of C or of C++, a `.js` file
    one with or without elements); empty and blank files are valid. Whole contents are parsed in one narrow stage, each row by itself, so repeated rows have equal verdicts.
    """
    ext = F.lower(F.regexp_extract("id", r"\.([A-Za-z]+)$", 1))
    language = F.coalesce(_lookup(ext, EXTENSIONS), _lookup(F.lower(F.trim("language")), SPELLINGS))
    src = files.filter(F.col("id").isNotNull() & F.col("content").isNotNull()).select(F.col("id").alias("source_id"), language.alias("language"), "content")

    def run(batches):
        held = gc.get_threshold()
        gc.set_threshold(100_000, 50, 50)  # stacks are many small objects that counting frees; cycles among them are rare
        try:
            yield from parsed(batches)
        finally:
            gc.set_threshold(*held)

    def parsed(batches):
        for b in batches:
            valid, reason = [], []
            for lang, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ok, why = (None, "no grammar") if lang is None else parse(content, lang)
                valid.append(ok)
                reason.append(why)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(valid, pa.bool_()), pa.array(reason, pa.string())], names=["source_id", "language", "valid", "reason"])

    out = src.mapInArrow(run, "source_id string, language string, valid boolean, reason string")
    named = F.coalesce(_lookup(F.col("language"), REPORTED), F.col("language"))
    return out.select("source_id", F.substring_index("source_id", "/", 1).alias("repository"), named.alias("language"), "valid", "reason")


def broken(files: DataFrame) -> DataFrame:
    """Distinct source_id of the files of which some row isn't valid."""
    return verdicts(files).filter(~F.col("valid")).select("source_id").distinct()


def rates(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Per repository and language: files, broken files, their rate, and how many of the broken ones `errors` names.

    A file of several rows counts once, as broken if some row is. Only messages about syntax count; a message names a
    file by its id or by a node below it. Files without grammar are left out.
    """
    per = verdicts(files).filter(F.col("valid").isNotNull()).groupBy("source_id", "repository", "language").agg(F.max((~F.col("valid")).cast("int")).alias("broken"))
    about = F.lower("message").rlike("syntax|missing|ast contains errors")
    named = errors.filter(F.col("node_id").isNotNull() & about).select(F.regexp_replace("node_id", r"/ERROR_\d+$", "").alias("source_id")).distinct().withColumn("named", F.lit(1))
    j = per.join(named, "source_id", "left")
    return j.groupBy("repository", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("broken").alias("n_broken"), F.avg("broken").alias("broken_rate"), F.coalesce(F.sum(F.col("broken") * F.col("named")), F.lit(0)).alias("n_broken_named")
    )
