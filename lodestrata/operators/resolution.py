"""From what code says to the files it means: specifiers, imports, tokens at positions, order and priority of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions tried for a specifier, in order, by language.
EXTENSIONS = {"go": ("go",), "rust": ("rs",), "python": ("py",), "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "javascript": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "c": ("h", "hpp", "hh", "c", "cc", "cpp", "cxx"), "cpp": ("h", "hpp", "hh", "c", "cc", "cpp", "cxx")}


def resolve_specifiers(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, language, spec, target, confidence): the files that an import specifier means, in its repository.

    specs: repository, language, spec; files: id. Leading ./ and ../ are taken off and the rest is cut at : / and dots.
    From the last part to the first, a file named part.ext in the language's order of extensions counts, else one named
    like the part; the last part gives 0.85 or 0.8, earlier ones 0.7 or 0.65. Failing all, files whose stem is the last
    part give 0.5. All files of the name that wins are targets. NULL, blank and unknown specifiers resolve to nothing.

    Candidates are rows (a handful per distinct specifier) joined with distinct (repository, name), so however many
    files share a name, they meet only the specifiers that it wins for.
    """
    bare = F.regexp_replace(F.trim("spec"), r"^(?:\.\.?/)+", "")
    parts = F.filter(F.split(bare, "[:/.]"), lambda p: p != "")
    s = specs.filter(F.col("spec").isNotNull()).select("repository", "language", "spec", parts.alias("parts")).distinct().filter(F.size("parts") > 0)
    exts = F.coalesce(F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])[F.col("language")], F.array().cast("array<string>"))
    n = F.size("parts")
    each = s.withColumn("exts", exts).select("repository", "language", "spec", n.alias("n"), F.posexplode("parts").alias("i", "part"), "exts")
    tried = each.select("repository", "language", "spec", "n", "i", F.posexplode(F.concat(F.transform("exts", lambda e: F.concat("part", F.lit("."), e)), F.array("part"))).alias("k", "name"), F.size("exts").alias("m"))
    last = F.col("i") + 1 == F.col("n")
    named = F.col("k") < F.col("m")
    tried = tried.select("repository", "language", "spec", ((F.col("n") - 1 - F.col("i")) * 100 + F.col("k")).alias("order"), "name", F.when(last & named, 0.85).when(last, 0.8).when(named, 0.7).otherwise(0.65).alias("confidence"))
    stem = s.select("repository", "language", "spec", F.lit(1_000_000).alias("order"), F.concat(F.lit("\x00"), F.element_at("parts", -1)).alias("name"), F.lit(0.5).alias("confidence"))
    base = F.substring_index("id", "/", -1)
    every = files.filter(F.col("id").isNotNull()).select("id").distinct().select("id", F.substring_index("id", "/", 1).alias("repository"), base.alias("base"))
    index = every.select("repository", F.col("base").alias("name"), "id").unionByName(every.filter(F.col("base").rlike(r"^.+\.[^.]+$")).select("repository", F.concat(F.lit("\x00"), F.regexp_replace("base", r"\.[^.]+$", "")).alias("name"), "id"))
    hit = tried.unionByName(stem).join(index.select("repository", "name").distinct(), ["repository", "name"])
    best = hit.groupBy("repository", "language", "spec").agg(F.min(F.struct("order", "name", "confidence")).alias("b")).select("repository", "language", "spec", "b.name", "b.confidence")
    return best.join(index, ["repository", "name"]).select("repository", "language", "spec", F.col("id").alias("target"), "confidence")


def resolve_imports(refs: DataFrame, imports: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """(source_id, token, qualifier, via_import[, n_candidates]) of each distinct reference.

    via_import is the path of the file's first import (by row, then path) whose alias is the reference's token or its
    qualifier; NULL if there is none. Candidates are all definitions of the token, wherever they are: their number, since
    a hot token has too many to list in a row (`find_defs` lists them).
    """
    r = refs.select("source_id", "token", "qualifier").distinct()
    alias = r.select("source_id", "token", "qualifier", F.explode(F.array_distinct(F.filter(F.array("token", "qualifier"), lambda x: x.isNotNull()))).alias("alias"))
    first = imports.filter(F.col("token").isNotNull()).groupBy("source_id", F.col("token").alias("alias")).agg(F.min(F.struct("row", F.col("qualifier").alias("path"))).alias("i"))
    via = alias.join(first, ["source_id", "alias"]).groupBy("source_id", "token", F.coalesce("qualifier", F.lit("\x00")).alias("q")).agg(F.min("i").alias("i"))
    out = r.withColumn("q", F.coalesce("qualifier", F.lit("\x00"))).join(via, ["source_id", "token", "q"], "left").select("source_id", "token", "qualifier", F.col("i.path").alias("via_import"))
    if defs is None:
        return out
    counts = defs.groupBy("token").agg(F.countDistinct("node_id", "source_id").alias("n_candidates"))
    return out.join(counts, "token", "left").select("source_id", "token", "qualifier", "via_import", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def region_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(a, b, confidence): mean confidence of edges (source, target, confidence) between regions; files: file, region.

    Undirected; edges within a region don't count; held within 0 and 1."""
    r = files.select("file", "region").distinct()
    j = edges.join(r.select(F.col("file").alias("source"), F.col("region").alias("x")), "source").join(r.select(F.col("file").alias("target"), F.col("region").alias("y")), "target").filter("x != y")
    return j.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("confidence"))).alias("confidence"))


def parse_order(files: DataFrame, region: Column, path: str = "id") -> DataFrame:
    """(region, depth, path) of each distinct file in the order in which a parse takes them: a range-partitioned sort."""
    f = files.filter(F.col(path).isNotNull()).select(region.alias("region"), (F.size(F.split(path, "/")) - 1).alias("depth"), F.col(path).alias("path")).distinct()
    return f.orderBy("region", "depth", "path")


def drain(queue: DataFrame, batch: int = 32) -> DataFrame:
    """The tasks (node_id, priority) of the next batch: a node's latest promotion counts, the latest come first, of equal
    ones the greater id. Two partial top-k steps; the batch size is the feature."""
    return queue.groupBy("node_id").agg(F.max("priority").alias("priority")).orderBy(F.desc("priority"), F.desc("node_id")).limit(batch)


def policy_stats(results: DataFrame) -> DataFrame:
    """(policy, false_skips, sound_skips) of rows (policy, skips, changed): skipped though, or as, nothing changed."""
    return results.groupBy("policy").agg(F.count_if(F.col("skips") & F.col("changed")).alias("false_skips"), F.count_if(F.col("skips") & ~F.col("changed")).alias("sound_skips"))


def decayed(pairs: DataFrame, at: str, now, tau_seconds: float = 90 * 86_400.0) -> DataFrame:
    """(a, b, weight): co-edit weights of pairs (a, b, time): exp(-age / tau) each, an age in the future being 0."""
    age = F.greatest(F.lit(0.0), F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    return pairs.groupBy("a", "b").agg(F.sum(F.exp(-age / tau_seconds)).alias("weight"))


# ---------------------------------------------------------------- text at positions


def token_at(text: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """The text of a range (lines and columns from 0, in characters); NULL where the range leaves the text."""
    lines = F.split(text, "\n")
    first, last = F.get(lines, start_line), F.get(lines, end_line)
    one = F.when((start_col <= end_col) & (end_col <= F.length(first)), F.substring(first, start_col + 1, end_col - start_col))
    inner = F.slice(lines, start_line + 2, F.greatest(end_line - start_line - 1, F.lit(0)))
    many = F.when((start_col <= F.length(first)) & (end_col <= F.length(last)), F.concat(F.array_join(F.concat(F.array(F.substring(first, start_col + 1, F.length(first))), inner), "\n"), F.lit("\n"), F.substring(last, F.lit(1), end_col)))
    return F.when((start_line >= 0) & (start_line < F.size(lines)), F.when(start_line == end_line, one).when((end_line > start_line) & (end_line < F.size(lines)), many))


def qualifier_at(text: Column, line: Column, col: Column) -> Column:
    """The name before the dot right in front of a position; NULL without one. Of a.b.c at c it is b."""
    before = F.substring(F.get(F.split(text, "\n"), line), F.lit(1), col)
    return F.nullif(F.regexp_extract(before, r"([A-Za-z0-9_]+)\.$", 1), F.lit(""))


def references_with_text(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, source_id, line, col, token, qualifier) of language-server references, read from the file itself.

    A file's references are folded to distinct positions first and joined with one text per file, so a text travels once
    per file and is unpacked in place.
    """
    at = F.struct("node_id", F.col("ref_start_line").alias("line"), F.col("ref_start_col").alias("col"), F.col("ref_end_line").alias("end_line"), F.col("ref_end_col").alias("end_col"))
    r = refs.filter(F.col("ref_uri").isNotNull()).select(F.regexp_replace("ref_uri", "^file:///?", "").alias("source_id"), at.alias("at")).distinct()
    text = files.filter(F.col("content").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("ingested_at", "content")).alias("c")).select(F.col("id").alias("source_id"), F.decode("c.content", "UTF-8").alias("text"))
    j = r.join(text, "source_id").select("source_id", "text", "at.*")
    return j.select("node_id", "source_id", "line", "col", token_at(F.col("text"), F.col("line"), F.col("col"), F.col("end_line"), F.col("end_col")).alias("token"), qualifier_at(F.col("text"), F.col("line"), F.col("col")).alias("qualifier"))


# ---------------------------------------------------------------- chunked content


def manifest_freshness(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, state): whether a file's chunk list is `fresh`, `stale` (older than the file's last row) or `missing`."""
    f = files.filter(F.col("id").isNotNull() & F.col("content").isNotNull()).groupBy(F.col("id").alias("source_id")).agg(F.max("ingested_at").alias("written"))
    m = manifest.filter(F.col("node_id").isNotNull()).groupBy(F.col("node_id").alias("source_id")).agg(F.max("ingested_at").alias("chunked"))
    state = F.when(F.col("chunked").isNull(), "missing").when(F.col("chunked") < F.col("written"), "stale").otherwise("fresh")
    return f.join(m, "source_id", "left").select("source_id", state.alias("state"))


def activation(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that a backfill still has to cut into chunks, with the reason: one job takes them all, in no order."""
    return manifest_freshness(files, manifest).filter("state != 'fresh'")


def verified_pages(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, seq, verdict): each distinct entry of a chunk list as a verified read sees it: `ok`, `missing` (no such
    chunk), `length` (the chunk's bytes aren't as many as it or the list says) or `gap` (it doesn't begin where the one
    before it ends)."""
    from pyspark.sql import Window as W

    m = manifest.filter(F.col("node_id").isNotNull()).select("node_id", "seq", "chunk_hash", "byte_offset", "byte_len").distinct()
    c = chunks.groupBy("chunk_hash").agg(F.min(F.octet_length("chunk_bytes")).alias("least"), F.max(F.octet_length("chunk_bytes")).alias("most"), F.max("chunk_len").alias("said"))
    before = F.lag(F.col("byte_offset") + F.col("byte_len")).over(W.partitionBy("node_id").orderBy("seq", "byte_offset", "chunk_hash"))  # chunks of one file
    m = m.withColumn("expected", F.coalesce(before, F.lit(0)))
    bad = (F.col("least") != F.col("most")) | (F.col("least") != F.col("said")) | (F.col("least") != F.col("byte_len"))
    verdict = F.when(F.col("said").isNull() & F.col("least").isNull(), "missing").when(F.coalesce(bad, F.lit(True)), "length").when(F.col("byte_offset") != F.col("expected"), "gap").otherwise("ok")
    return m.join(c, "chunk_hash", "left").select("node_id", "seq", verdict.alias("verdict"))
