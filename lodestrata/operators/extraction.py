"""Facts from source text: definitions, references and imports per file, Merkle folds of trees, fallthrough edges."""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.kinds import LANGUAGE_OF

_STRIP = {
    "c": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
    "hash": re.compile(r"\#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'[^']*'", re.S),
}
_DEFS = {
    "go": re.compile(r"^func\s+(?:\([^)]*?(\w+)\)\s+)?(\w+)\s*[\[(]|^type\s+()(\w+)", re.M),
    "rust": re.compile(r"\bfn\s+()(\w+)|\b(?:struct|enum|trait|type|union)\s+()(\w+)"),
    "javascript": re.compile(r"\bfunction\s*\*?\s+()([\w$]+)|\bclass\s+()([\w$]+)"),
    "java": re.compile(r"\b(?:class|interface|enum|record)[ \t]+()(\w+)|^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)+(?:<[^>\n]*>[ \t]*)?[\w.]+(?:<[^(\n]*>)?(?:\[\])*[ \t]+()(\w+)[ \t]*\(", re.M),
    "c": re.compile(r"^[A-Za-z_]\w*(?:[ \t]+\w+){0,6}[ \t*]+()(\w+)[ \t]*\([^;{}()]*\)\s*\{|\b(?:struct|enum|union)[ \t]+()(\w+)\s*\{", re.M),
    "bash": re.compile(r"^\s*(?:function\s+)?()([\w-]+)\s*\(\)", re.M),
}
_DEFS["typescript"] = re.compile(_DEFS["javascript"].pattern + r"|\b(?:interface|enum)\s+()([\w$]+)")
_CALL = re.compile(r"(?:([\w$]+)\s*(\.|::|->)\s*)?([A-Za-z_$][\w$]*)\s*\(")
_IMPORTS = {
    "go": re.compile(r"(?:^import\s+|^\s+)(?:([\w.]+)\s+)?\"([^\"]+)\"", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+?)(?:::(\w+))?(?:\s+as\s+(\w+))?;", re.M),
    "javascript": re.compile(r"^\s*import\s+(?:\*\s+as\s+(\w+)|([\w$]+)|\{[^}]*\})?\s*(?:from\s+)?['\"]([^'\"]+)['\"]", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+|\*);", re.M),
    "c": re.compile(r"^\s*\#\s*include\s*[<\"]([^>\"]+)[>\"]", re.M),
    "bash": re.compile(r"^\s*(?:source|\.)\s+([\w./-]+)", re.M),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_KEYWORDS = frozenset("if for while switch catch return function func fn def match sizeof new typeof await yield defer go select case elif else do until then fi done esac and or not in is lambda assert raise throw print".split())


def _python(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        for child in ast.iter_child_nodes(node):
            child._up = node
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            up = getattr(node, "_up", None)
            yield "def", node.name, up.name if isinstance(up, ast.ClassDef) else None, node.lineno - 1
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                yield "ref", f.id, None, node.lineno - 1
            elif isinstance(f, ast.Attribute):
                yield "ref", f.attr, f.value.id if isinstance(f.value, ast.Name) else None, node.lineno - 1
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.asname or a.name.rsplit(".", 1)[-1], a.name, node.lineno - 1
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "import", a.asname or a.name, f"{'.' * node.level}{node.module or ''}.{a.name}", node.lineno - 1


def facts_of(text: str, language: str):
    """(what, token, qualifier or path, row): definitions, references (qualified ones twice: with and without), imports."""
    if language == "python":
        rows = list(_python(text))
    else:
        blank = lambda m: "".join(c if c == "\n" else " " for c in m[0])
        bare = _STRIP["hash" if language == "bash" else "c"].sub(blank, text)
        rows, at = [], lambda i: text.count("\n", 0, i)
        names = set()
        for m in _DEFS.get(language, re.compile(r"(?!)")).finditer(bare):
            g = [x for x in m.groups() if x]
            if g and g[-1] not in _KEYWORDS:
                rows.append(("def", g[-1], g[0] if len(g) > 1 else None, at(m.start())))
                names.add((g[-1], m.end()))
        ends = {e for _, e in names}
        for m in _CALL.finditer(bare) if language != "bash" else ():
            if m[3] not in _KEYWORDS and m.end() not in ends and not any(abs(m.end() - e) <= 1 for e in ends):
                rows.append(("ref", m[3], m[1], at(m.start())))
        for m in _IMPORTS.get(language, re.compile(r"(?!)")).finditer(text):
            g = [x for x in m.groups() if x]
            if g:
                path = g[-1] if language in ("go", "javascript", "typescript") else g[0] if language in ("c", "bash") else (f"{m[1]}::{m[2]}" if language == "rust" and m[2] else m[1] if language == "rust" else f"{m[1]}.{m[2]}")
                alias = g[0] if len(g) > 1 and language in ("go", "javascript", "typescript") else (m[3] or m[2] or m[1].rsplit("::", 1)[-1]) if language == "rust" else re.split(r"[/.]", path.rstrip("/"))[-1] if language != "c" else path.rsplit("/", 1)[-1]
                rows.append(("import", alias, path, at(m.start())))
    for what, token, q, row in rows:
        if what != "import" and q:
            yield what, f"{q}.{token}", q, row
        yield what, token, q, row


def extract(files: DataFrame) -> DataFrame:
    """(source_id, what, token, qualifier, row) of each distinct file: what is def, ref or import (qualifier: its path).

    Python is parsed exactly; other languages by rules over text whose strings and comments are blanked out.
    """
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[F.lower(F.regexp_extract("id", r"\.([A-Za-z]+)$", 1))]
    src = files.filter(F.col("content").isNotNull()).select(F.col("id").alias("source_id"), lang.alias("language"), F.decode("content", "UTF-8").alias("text")).filter("language IS NOT NULL").dropDuplicates(["source_id", "text"])

    def run(batches):
        for pdf in batches:
            rows = [(s, *f) for s, lang, t in zip(pdf["source_id"], pdf["language"], pdf["text"]) for f in facts_of(t.lstrip("﻿"), lang)]
            yield pd.DataFrame(rows, columns=["source_id", "what", "token", "qualifier", "row"])

    return src.mapInPandas(run, "source_id string, what string, token string, qualifier string, row long")


def fold_hashes(nodes: DataFrame) -> DataFrame:
    """(node_id, subtree_hash, n_nodes): Merkle fold of syntax trees whose ids are paths.

    A node's hash covers its kind and its children's hashes in order of position; the children of one node are one list by
    nature. Trees are folded from the deepest level up, a level per step, in one plan of as many steps as the trees are
    deep. Comments are no part of it. SHA-256 takes the place of a hash that isn't available here.
    """
    from lodestrata.session import Workspace

    ws = Workspace(nodes.sparkSession, "fold")
    cur = nodes.filter(~F.col("node_kind").isin("comment", "line_comment", "block_comment")).select("node_id", "node_kind", "start_byte").dropDuplicates(["node_id"])
    cur = cur.withColumn("up", F.regexp_replace("node_id", "/[^/]*$", "")).withColumn("level", F.size(F.split("node_id", "/")))
    cur = ws.write(cur)
    deepest, top = cur.agg(F.max("level"), F.min("level")).first()
    if deepest is None:
        return cur.select("node_id", F.lit("").alias("subtree_hash"), F.lit(1).cast("long").alias("n_nodes"))
    below, out = None, None
    for lv in range(deepest, top - 1, -1):
        here = cur.filter(F.col("level") == lv)
        if below is None:
            h = here.select("node_id", "up", "start_byte", F.sha2(F.concat(F.lit("0"), "node_kind"), 256).alias("subtree_hash"), F.lit(1).cast("long").alias("n_nodes"))
        else:
            kids = below.groupBy(F.col("up").alias("pid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_byte", "node_id", "subtree_hash"))), lambda x: x["subtree_hash"]), "").alias("k"), F.sum("n_nodes").alias("s"))
            h = here.join(kids, F.col("node_id") == F.col("pid"), "left").select("node_id", "up", "start_byte", F.sha2(F.concat(F.when(F.col("k").isNull(), "0").otherwise("1"), "node_kind", F.coalesce("k", F.lit(""))), 256).alias("subtree_hash"), (1 + F.coalesce("s", F.lit(0))).cast("long").alias("n_nodes"))
        below = ws.write(h)
        out = below if out is None else out.unionByName(below)
    return out.select("node_id", "subtree_hash", "n_nodes")


def fallthrough_edges(calls: DataFrame) -> DataFrame:
    """Edges between neighbouring blocks of a function in order of position: (container, from_id, to_id, 'fallthrough')."""
    from pyspark.sql import Window as W

    c = calls.select("node_id", F.regexp_replace("node_id", "/[^/]*$", "").alias("container"), "start_byte").dropDuplicates(["node_id"])
    nxt = F.lead("node_id").over(W.partitionBy("container").orderBy("start_byte", "node_id"))
    return c.select("container", F.col("node_id").alias("from_id"), nxt.alias("to_id"), F.lit("fallthrough").alias("edge_kind")).filter("to_id IS NOT NULL")


def address(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Order-free address of a set of rows per group: hash of the sorted distinct row digests."""
    d = rows.select(*keys, F.sha2(F.col(value).cast("binary"), 256).alias("d")).distinct()
    return d.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("address"))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
