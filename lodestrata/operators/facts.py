"""Fact tables and the lookups, listings and definition-reference joins over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import kinds as K
from lodestrata.functions import patterns as P
from lodestrata.session import Workspace

MAX_BYTES = 8 * 1024 * 1024
SNIFF_BYTES = 8 * 1024

#: the name in a signature: the word before the first parameter list, a receiver left aside
NAME_IN_SIGNATURE = r"^(?:func \([^)]*\) )?[^(]*?(\w+)\s*(?:<[^>]*>)?\("


def node_defs(symbols: DataFrame, ast: DataFrame) -> DataFrame:
    """Definitions (token, node_id, source_id, container_node_id, canonical_kind): named functions and methods.

    A symbol without signature defines nothing; repeated rows are folded. The container is the node above the id.
    """
    named = symbols.filter(F.col("detail").isNotNull()).select("node_id", F.regexp_extract("detail", NAME_IN_SIGNATURE, 1).alias("token"), F.col("symbol_kind").alias("canonical_kind")).filter("token != ''").distinct()
    where = ast.filter(F.col("node_kind").isin("function_declaration", "method_declaration", "function_definition", "function_item", "method_definition")).select("node_id", "source_id").distinct()
    above = F.regexp_replace("node_id", "/[^/]*$", "")
    return named.join(where, "node_id").select("token", "node_id", "source_id", F.when(above != F.col("source_id"), above).alias("container_node_id"), "canonical_kind")


# ---------------------------------------------------------------- scans and guards


def readable(files: DataFrame) -> DataFrame:
    """Files that an ingest reads: at most 8 MiB, without a NUL byte in the first 8 KiB; NULL content is left out."""
    head = F.substring("content", 1, SNIFF_BYTES)
    return files.filter(F.col("content").isNotNull() & (F.octet_length("content") <= MAX_BYTES) & ~F.hex(head).rlike("^(?:..)*?00"))


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """A statement's rows; statements that write are refused. Cells keep their types."""
    word = sql.lstrip(" \t\r\n(").split(None, 1)[0].lower() if sql.strip(" \t\r\n(") else ""
    if word not in ("select", "with", "values", "table", "from", "show", "describe", "desc", "explain"):
        raise ValueError("only statements that read are allowed")
    return spark.sql(sql)


def select_query(spark: SparkSession, sql: str, limit: int = 1000) -> tuple[DataFrame, bool]:
    """At most `limit` rows of a read-only statement, and whether there were more (the cap is the surface's feature)."""
    df = read_only(spark, sql)
    return df.limit(limit), df.limit(limit + 1).count() > limit


# ---------------------------------------------------------------- nodes


def list_roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNull() | (F.col("parent_id") == "")).select("id", "name", "kind", "size").distinct()


def list_children(nodes: DataFrame, parent: str) -> DataFrame:
    """Children of a node by name, without their records."""
    return nodes.filter(F.col("parent_id") == parent).select("id", "name", "kind", "size").distinct().orderBy("name", "id")


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter(F.col("id") == node)


def read_content(nodes: DataFrame, node: str) -> DataFrame:
    """The record of a node; none for a missing node and for a NULL record alike."""
    return nodes.filter((F.col("id") == node) & F.col("record").isNotNull()).select("id", "record").distinct()


def lookup_child(nodes: DataFrame, parent: str, name: str) -> DataFrame:
    return nodes.filter((F.col("parent_id") == parent) & (F.col("name") == name)).select("id").distinct()


def file_contents(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("kind") == 0) & F.col("record").isNotNull() & (F.col("record") != "")).select("id", "record").distinct()


def directory_rows(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every ancestor directory of the paths once: id, parent_id ('' at the top), name, kind 1."""
    above = F.explode(F.expr(f"transform(sequence(1, size(split(`{path}`, '/')) - 1), k -> array_join(slice(split(`{path}`, '/'), 1, k), '/'))")).alias("id")
    dirs = paths.filter(F.col(path).contains("/")).select(F.regexp_replace(path, "/[^/]*$", "").alias(path)).distinct().select(F.concat(F.col(path), F.lit("/x")).alias(path)).select(above).distinct()
    return dirs.select("id", F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]*$", "")).otherwise(F.lit("")).alias("parent_id"), F.substring_index("id", "/", -1).alias("name"), F.lit(1).alias("kind"))


def orphan_directories(nodes: DataFrame) -> DataFrame:
    """Directories below which there is no file, at any depth: what the sweep removes.

    Directories that hold a file somewhere are the ancestors in the paths of files, so no repeated sweep is needed.
    """
    cur = nodes.select("id", "kind").distinct()
    held = directory_rows(cur.filter("kind = 0"), "id").select(F.col("id").alias("held"))
    return cur.filter("kind = 1").join(held, F.col("id") == F.col("held"), "left_anti").select("id")


# ---------------------------------------------------------------- references and definitions


def find_callers(refs: DataFrame, token: str) -> DataFrame:
    """References of a token, repeated rows included."""
    return refs.filter(F.col("token") == token).select("token", "node_id", "source_id", "container_node_id", "qualifier")


def find_defs(defs: DataFrame, token: str) -> DataFrame:
    return defs.filter(F.col("token") == token)


def find_callees(refs: DataFrame, defs: DataFrame, container: str) -> DataFrame:
    """Definitions of every token that a container references, each once."""
    used = refs.filter((F.col("container_node_id") == container) | (F.col("node_id") == container)).select("token").distinct()
    return defs.join(used, "token", "left_semi").select("token", "node_id", "source_id").distinct()


def call_edges(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(caller, callee) definitions over the whole corpus with the number of call sites.

    Sites are folded by (container, token) before the join, so a hot token is one row per caller; hot keys that are left
    are split by adaptive execution.
    """
    sites = refs.filter(F.col("container_node_id").isNotNull()).groupBy("container_node_id", "token").agg(F.count(F.lit(1)).alias("n_sites"))
    return sites.join(defs.select("token", F.col("node_id").alias("callee")).distinct(), "token").groupBy(F.col("container_node_id").alias("caller"), "callee").agg(F.sum("n_sites").alias("n_sites"))


def token_map(df: DataFrame, token: str = "token", node: str = "node_id", per_row: int = 1000) -> DataFrame:
    """(token, repository, part, node_ids): each token's distinct node ids in order, at most `per_row` of them to a row.

    A token may hold a third of all rows, so its ids are numbered per repository and never gathered in one row or task.
    The map of a token is the union of its rows. NULL tokens and ids are left out.
    """
    from pyspark.sql import Window as W

    ids = df.filter(F.col(token).isNotNull() & F.col(node).isNotNull()).select(token, node, F.substring_index(node, "/", 1).alias("repository")).distinct()
    part = F.floor((F.row_number().over(W.partitionBy(token, "repository").orderBy(node)) - 1) / per_row)
    return ids.withColumn("part", part).groupBy(token, "repository", "part").agg(F.sort_array(F.collect_list(node)).alias("node_ids"))


def fan_out(refs: DataFrame) -> DataFrame:
    return refs.filter(F.col("container_node_id").isNotNull()).groupBy("container_node_id").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("token").alias("n_tokens"))


def unreferenced(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Dead code candidates: definitions whose token is never referenced."""
    return defs.join(refs.select("token").distinct(), "token", "left_anti").select("token", "node_id", "source_id")


def definitions_with_spans(defs: DataFrame, ast: DataFrame) -> DataFrame:
    """Definitions with kind and span of their node; without a node the kind is '' and the positions 0."""
    spans = ast.select("node_id", "source_id", "node_kind", "start_row", "start_col", "end_row", "end_col", "start_byte", "end_byte").dropDuplicates(["node_id", "source_id"])
    j = defs.select("token", "node_id", "source_id").distinct().join(spans, ["node_id", "source_id"], "left")
    nums = ["start_row", "start_col", "end_row", "end_col", "start_byte", "end_byte"]
    return j.select("token", "node_id", "source_id", F.coalesce("node_kind", F.lit("")).alias("node_kind"), *[F.coalesce(c, F.lit(0)).alias(c) for c in nums]).withColumn("kind", K.symbol_class(F.col("node_kind")))


def search_symbols(defs: DataFrame, ast: DataFrame, pattern: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols by GLOB. The limit is applied before the kind filter, as the surface defines it."""
    found = definitions_with_spans(defs.filter(P.glob(F.col("token"), pattern)), ast).select("token", "node_id", "source_id", "kind").orderBy("token", "node_id").limit(limit)
    return found if kind is None else found.filter(F.col("kind") == kind)


def symbols_of_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.filter(P.like_prefix(F.col("node_id"), file)).select("node_id", "symbol_kind", "detail", "start_line", "end_line").distinct()


def diagnostics(symbols: DataFrame) -> DataFrame:
    """Diagnostics as rows: severity and message of each entry; malformed JSON gives none."""
    item = T.ArrayType(T.StructType([T.StructField("severity", T.LongType()), T.StructField("message", T.StringType())]))
    parsed = symbols.filter(F.col("diagnostics").isNotNull() & (F.col("diagnostics") != "")).select("node_id", "diagnostics").distinct().select("node_id", F.explode(F.from_json("diagnostics", item)).alias("d"))
    return parsed.select("node_id", "d.severity", "d.message")


def included(df: DataFrame, sections: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """Columns named in `sections` without regard to case; an empty list means all."""
    if not sections:
        return df
    want = {s.lower() for s in sections}
    return df.select(*[c for c in df.columns if c.lower() in want or c in always])


def needs_enrichment(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files without any symbol row: what a lazy enrichment would queue."""
    have = symbols.select(F.regexp_extract("node_id", r"^(.*?\.[A-Za-z]+)/", 1).alias("source_id")).distinct()
    return files.select(F.col("id").alias("source_id")).distinct().join(have, "source_id", "left_anti")


def inspect_symbol(token: str, defs: DataFrame, refs: DataFrame, ast: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: number of definitions, kind of the first one (by source and node), distinct callers, hover, certainty.

    The definitions themselves are `definitions_with_spans` of the token, as rows.
    """
    d = definitions_with_spans(defs.filter(F.col("token") == token), ast)
    dd = d.agg(F.count(F.lit(1)).cast("int").alias("n_definitions"), F.min(F.struct("source_id", "node_id", "kind")).alias("first"))
    callers = refs.filter((F.col("token") == token) & F.col("container_node_id").isNotNull()).agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("container_node_id").alias("n_callers"))
    hover = symbols.join(d.select("node_id").distinct(), "node_id", "left_semi").agg(F.max("detail").alias("hover"))
    return dd.crossJoin(callers).crossJoin(hover).select(  # three single rows
        F.lit(token).alias("symbol"), "n_definitions", F.coalesce("first.kind", F.lit("unknown")).alias("kind"), "n_references", "n_callers", "hover",
        F.when(F.col("hover").isNotNull(), "full").otherwise("partial").alias("certainty"),
    )


def neighborhood(token: str, refs: DataFrame, defs: DataFrame, depth: int = 2, per_hop: int = 20, max_cells: int = 1000) -> DataFrame:
    """(symbol, hop): names reached from a symbol over callers and callees, each at its first hop.

    At most 4 hops; per focal the first 2 * per_hop names in alphabetical order (callees before callers), and max_cells in
    all: these caps are the feature. The frontier is at most max_cells names, so it is broadcast.
    """
    owner = defs.select(F.col("token").alias("owner"), F.col("node_id").alias("container_node_id")).distinct()
    edges = refs.filter(F.col("container_node_id").isNotNull()).select("container_node_id", "token").distinct().join(owner, "container_node_id").select("owner", "token").distinct()
    known = defs.select("token").distinct()
    callees = edges.join(known, "token", "left_semi").select(F.col("owner").alias("focal"), F.col("token").alias("symbol"), F.lit(0).alias("side"))
    callers = edges.select(F.col("token").alias("focal"), F.col("owner").alias("symbol"), F.lit(1).alias("side"))
    spark = refs.sparkSession
    links = Workspace(spark, "neighborhood").write(callees.unionByName(callers).filter("focal != symbol"))  # read once per hop
    seen, front, rows = {token}, [token], []
    from pyspark.sql import Window as W

    for hop in range(1, min(depth, 4) + 1):
        f = spark.createDataFrame([(x,) for x in front], "focal string")
        near = links.join(F.broadcast(f), "focal").withColumn("k", F.row_number().over(W.partitionBy("focal").orderBy("side", "symbol"))).filter(F.col("k") <= 2 * per_hop)
        got = [r[0] for r in near.groupBy("symbol").agg(F.min("focal").alias("focal")).orderBy("focal", "symbol").select("symbol").limit(max_cells + len(seen)).collect() if r[0] not in seen]
        got = got[: max_cells - len(rows)]
        rows += [(s, hop) for s in got]
        seen.update(got)
        front = got
        if not front or len(rows) >= max_cells:
            break
    return spark.createDataFrame(rows, "symbol string, hop int")
