"""Syntax rows from source text, sections of a symbol's bundle, random projections, incremental chunking."""

from __future__ import annotations

import ast
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.chunks import boundaries
from lodestrata.operators.facts import definitions_with_spans
from lodestrata.operators.hypervectors import splitmix64

# ---------------------------------------------------------------- syntax rows

# Node kinds of the syntax classes that are projected.
PYTHON_KINDS = {"FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Call": "call", "Import": "import_statement", "ImportFrom": "import_from_statement"}
ROWS = "node_id string, source_id string, node_kind string, name string, container_node_id string, start_byte long, end_byte long, start_row long, start_col long, end_row long, end_col long"


def python_nodes(source: str, content: bytes) -> list[tuple]:
    """Rows of one Python text: the module, then classes, functions, calls and imports in order of position.

    Ids are `<parent's id>/<kind>_<i>`, i counting the parent's children of that kind; the container is the innermost
    class or function around. Columns are bytes, rows count from 0. A text that doesn't parse has no rows. A stack takes
    the place of calls, so depth costs none.
    """
    body = content.removeprefix(b"\xef\xbb\xbf")
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    skipped = len(content) - len(body)
    starts, at = [skipped], skipped
    for line in body.splitlines(keepends=True):
        at += len(line)
        starts.append(at)
    last = body.count(b"\n")
    rows = [(source, source, "module", None, None, 0, len(content), 0, 0, last, len(body) - (body.rfind(b"\n") + 1))]
    todo, counts = [(tree, source, None)], {}
    while todo:
        node, above, container = todo.pop()
        inner = []
        for child in ast.iter_child_nodes(node):
            kind = PYTHON_KINDS.get(type(child).__name__)
            if kind is None:
                inner.append((child, above, container))
                continue
            i = counts[above, kind] = counts.get((above, kind), -1) + 1
            node_id = f"{above}/{kind}_{i}"
            r0, r1 = child.lineno - 1, child.end_lineno - 1
            rows.append((node_id, source, kind, getattr(child, "name", None), container, starts[r0] + child.col_offset, starts[r1] + child.end_col_offset, r0, child.col_offset, r1, child.end_col_offset))
            inner.append((child, node_id, node_id if kind in ("function_definition", "class_definition") else container))
        todo += reversed(inner)
    return rows


def project_python(files: DataFrame) -> DataFrame:
    """Syntax rows of every Python file with content, one narrow stage over whole texts; equal texts of one file once."""
    src = files.filter(F.col("content").isNotNull() & F.lower("id").rlike(r"\.pyi?$")).select("id", "content").dropDuplicates(["id", "content"])
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.string()] * 5 + [pa.int64()] * 6

    def run(batches):
        for b in batches:
            rows = [r for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in python_nodes(i, c)]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return src.mapInArrow(run, ROWS)


# ---------------------------------------------------------------- a symbol's bundle in sections


def symbol_sections(token: str, defs: DataFrame, refs: DataFrame, ast_nodes: DataFrame, symbols: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """(section, node_id, source_id, text): the bundle of a symbol as rows, so that sections of any size stay tables.

    definitions (text: kind), callers (containers of its references), callees (definitions of what its definitions
    reference; text: token), hover (signatures) and freshness (text: when the rows of its definitions came in last).
    include: the sections wanted, without regard to case; none means all.
    """
    spans = definitions_with_spans(defs.filter(F.col("token") == token), ast_nodes)
    own = spans.select("node_id").distinct()
    null = F.lit(None).cast("string")
    used = refs.join(own.select(F.col("node_id").alias("container_node_id")), "container_node_id", "left_semi").select("token").distinct()
    parts = {
        "definitions": spans.select("node_id", "source_id", F.col("kind").alias("text")),
        "callers": refs.filter((F.col("token") == token) & F.col("container_node_id").isNotNull()).select(F.col("container_node_id").alias("node_id"), "source_id", null.alias("text")),
        "callees": defs.join(used, "token", "left_semi").select("node_id", "source_id", F.col("token").alias("text")),
        "hover": symbols.filter(F.trim("detail") != "").join(own, "node_id", "left_semi").select("node_id", null.alias("source_id"), F.col("detail").alias("text")),
        "freshness": ast_nodes.join(own, "node_id", "left_semi").groupBy("node_id").agg(F.max("ingested_at").alias("t")).select("node_id", null.alias("source_id"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("text")),
    }
    wanted, out = {x.lower() for x in include}, None
    for name, df in parts.items():
        if not wanted or name in wanted:
            df = df.select(F.lit(name).alias("section"), "node_id", "source_id", "text").distinct()
            out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError(f"no such section among {sorted(parts)}")
    return out


# ---------------------------------------------------------------- random projections


def hyperplanes(seed: str, width: int, bits: int = 8192) -> np.ndarray:
    """bits x width normal numbers by Box-Muller over SplitMix64 streams, a stream per plane, from a seed alone."""
    out = np.empty((bits, width))
    base = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little")
    for i in range(bits):
        state, row = int.from_bytes(hashlib.sha256(base.to_bytes(8, "little") + i.to_bytes(8, "little")).digest()[:8], "little"), []
        while len(row) < width:
            u = []
            for _ in range(2):
                state, word = splitmix64(state)
                u.append(max((int(word) >> 40) / (1 << 24), np.finfo(np.float32).eps))
            r = math.sqrt(-2 * math.log(u[0]))
            row += [r * math.cos(2 * math.pi * u[1]), r * math.sin(2 * math.pi * u[1])]
        out[i] = row[:width]
    return out


def simhash(df: DataFrame, vector: str, planes: np.ndarray, name: str = "hv") -> DataFrame:
    """df with 64-bit words of which side of each plane a vector lies on: bit i is set if its product with plane i isn't
    negative. NULL vectors and other lengths have NULL. The planes (8 bytes x bits x width) go along as one broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(planes.T))

    @F.pandas_udf("array<bigint>")
    def run(v: pd.Series) -> pd.Series:
        h = shared.value
        ok = v.map(lambda x: x is not None and len(x) == h.shape[0])
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        if ok.any():
            signs = np.stack([np.asarray(x, dtype=float) for x in v[ok]]) @ h >= 0
            words = np.packbits(signs, axis=1, bitorder="little").view("<i8")
            for i, w in zip(v.index[ok], words):
                out[i] = w
        return out

    return df.withColumn(name, run(F.col(vector)))


# ---------------------------------------------------------------- incremental chunking


def rechunk(old: list[tuple[int, int]], data: bytes, edit_at: int, removed: int, inserted: int) -> tuple[list[tuple[int, int]], dict[str, int]]:
    """Boundaries of `data` after an edit of the text that `old` was cut from, and how much was reused.

    Chunks that end before the edit stay. From the chunk of the edit on, cutting starts anew until a cut falls on an old
    one behind the edit (moved by the change of length): a cut depends on nothing before its chunk, so all later ones
    stay, too. The result equals cutting the whole.
    """
    shift = inserted - removed
    head = [c for c in old if c[0] + c[1] <= edit_at]
    if head and head[-1][0] + head[-1][1] == len(data):
        head = head[:-1]
    # the last old chunk may have ended with the text rather than at a cut
    if old and head and head[-1] == old[-1]:
        head = head[:-1]
    start = head[-1][0] + head[-1][1] if head else 0
    behind = {o + shift: i for i, (o, _) in enumerate(old) if o >= edit_at + removed}
    out, cut = list(head), 0
    while start < len(data):
        if start in behind and start >= edit_at + inserted:
            tail = [(o + shift, n) for o, n in old[behind[start] :]]
            return out + tail, {"kept": len(head) + len(tail), "cut": cut}
        first = boundaries(data[start : start + (1 << 18)])[0]
        out.append((start, first[1]))
        start, cut = start + first[1], cut + 1
    return out, {"kept": len(head), "cut": cut}
