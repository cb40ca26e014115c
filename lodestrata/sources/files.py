"""Sources and sinks: source trees, transcripts, manifests, tables in files and databases."""

from __future__ import annotations

import os
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.kinds import language_of

# Directories that a walk leaves out.
SKIPPED = ("node_modules", "vendor", "target", "__pycache__", "__pypackages__", "venv")


def ignore_pattern(line: str, folder: str) -> tuple[bool, str] | None:
    """(keeps, regular expression over relative paths) of a line of the ignore file in `folder` ('' is the root).

    `!` keeps, a slash within anchors the pattern to the folder, one at the end asks for a directory; `*` and `?` stay
    within a name, `**` crosses names. Blank lines and comments are None.
    """
    p = line.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    keeps, p = p.startswith("!"), p.removeprefix("!")
    only_dir, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inner = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    start = re.escape(folder + "/" if folder else "") + ("" if anchored else "(?:.*/)?")
    return keeps, f"^{start}{out}{'/.+' if only_dir else '(?:/.+)?'}$"


def ignored(rel: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the rules, in order from the root downwards, leave a path out: the last one that fits decides."""
    out = F.lit(False)
    for keeps, pattern in rules:
        out = F.when(rel.rlike(pattern), F.lit(not keeps)).otherwise(out)
    return out


def _rules(root: str) -> list[tuple[bool, str]]:
    """The rules of all ignore files of a local tree, outer folders first."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs.sort()
        if ".gitignore" in names:
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                out += [r for r in (ignore_pattern(line, "" if rel == "." else rel) for line in f) if r]
    return out


def walk(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """Files of a source tree: id (relative path), path, language, size, mtime_ns, content; hidden and skipped ones left out.

    `binaryFile` lists and reads in parallel; the ignore files of all folders are read on the driver and applied as an
    expression over the paths.
    """
    base = "file:" + os.path.abspath(root) + "/" if "://" not in root else root.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index(F.col("path"), base, -1)
    df = df.select(rel.alias("id"), "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content").withColumn("language", language_of(F.col("id")))
    hidden = F.col("id").rlike(r"(?:^|/)\.") | F.col("id").rlike(r"(?:^|/)(?:" + "|".join(SKIPPED) + r")/")
    df = df.filter(~hidden)
    if language:
        df = df.filter(F.col("language") == language)
    return df.filter(~ignored(F.col("id"), _rules(root) if "://" not in root else []))


def changed_files(current: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state): new, changed or deleted against a file index (path, mtime, size); equal mtime and size is unchanged."""
    c = current.select(F.col("id").alias("path"), F.col("mtime_ns").alias("m1"), F.col("size").alias("s1"))
    i = index.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"))
    j = c.join(i, "path", "full")
    state = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "changed")
    return j.select("path", state.alias("state")).filter("state IS NOT NULL")


def manifests(files: DataFrame) -> DataFrame:
    """(source_id, kind, name, version) of pyproject.toml and Cargo.toml files; a file that doesn't parse gives none."""
    src = files.filter(F.col("id").rlike(r"(?:^|/)(?:pyproject|Cargo)\.toml$") & F.col("content").isNotNull()).select(F.col("id").alias("source_id"), F.decode("content", "UTF-8").alias("text"))

    def run(batches):
        for pdf in batches:
            rows = []
            for sid, text in zip(pdf["source_id"], pdf["text"]):
                try:
                    t = tomllib.loads(text)
                except tomllib.TOMLDecodeError:
                    continue
                cargo = sid.endswith("Cargo.toml")
                p = t.get("package" if cargo else "project", {})
                if isinstance(p, dict) and isinstance(p.get("name"), str):
                    rows.append((sid, "package", p["name"], p["version"] if isinstance(p.get("version"), str) else None))
                deps = t.get("dependencies", {}) if cargo else p.get("dependencies", []) if isinstance(p, dict) else []
                for d in deps.items() if isinstance(deps, dict) else [(x, None) for x in deps]:
                    rows.append((sid, "dependency", str(d[0]), d[1] if isinstance(d[1], str) else None))
            yield pd.DataFrame(rows, columns=["source_id", "kind", "name", "version"])

    return src.mapInPandas(run, "source_id string, kind string, name string, version string")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table in files (parquet, orc, csv, json, text) or a database (jdbc); other formats need their own connector."""
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
