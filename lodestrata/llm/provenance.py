"""Generated, minified, vendored and blob files: belief propagation over directory trees."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import heavy_keys, salted_join
from lodestrata.session import Workspace

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEND, BLOB = range(5)
DIR_WEIGHT = 10.0
MECHANICAL = 2.0
COPIED = 9.5

# ---------------------------------------------------------------- evidence of one file

_COMMENT = re.compile(r"^\s*(?://+!?|\#+!?|/\*+!?|\*+|--+|;+|<!--)?\s*(.*?)\s*(?:\*+/|-->)?\s*$")
# How tools and copies announce themselves at the start of a comment.
_GENERATED = re.compile(
    r"^(?:@generated\b|\W*(?:this (?:file|code|module|source) (?:is|was|has been)|this was|code|file|source|automatically|auto-?|machine[- ])?\s*(?:automatically |auto-?|machine[- ])?generated\b(?! (?:twin|code lives|files? (?:are|below))).*"
    r"(?:\bby\b|\bfrom\b|\bwith\b|do not|don't|hands off|lost|overwritten|instead|never|regenerate|edit|\(\w)|\W*(?:this (?:file|code) (?:is|was)|this was) (?:machine|auto|automatically|program)[- ]?(?:written|produced|created|generated)\b"
    r"|\W*(?:auto-?generated|automatically generated)\b(?! method stub).*(?:by|with|from|edit|lost|overwritten|instead|file)|(?:source|input|schema|template):.*\b(?:produced|generated|compiled|emitted|created) by\b|\W*(?:produced|compiled|emitted) by \S+.*(?:do not|never))",
    re.I,
)
# The same announcements in other languages.
_FOREIGN = re.compile(r"^\W*(?:automatisch (?:erzeugt|generiert|erstellt)|(?:fichier |code )?g[ée]n[ée]r[ée] automatiquement|auto-?g[ée]n[ée]r[ée]|(?:archivo |c[óo]digo )?generado autom[áa]ticamente|autogenerado|gerado automaticamente|generato automaticamente|автоматически|(?:此|本)?(?:文件|代码)?(?:由.{0,40})?自动(?:生成|产生)|(?:この|本)?(?:ファイル|コード)?は?(?:.{0,40}(?:により|によって|で))?自動生成)", re.I)
_TRAILER = re.compile(r"^\W*(?:end of (?:auto-?|automatically )?generated (?:file|code|section)|(?:auto-?)?generated in [\d.]+ ?m?s\b|generated (?:by|with) \S+ (?:in|at|on) )", re.I)
_VENDORED = re.compile(
    r"^\W*(?:vendored (?:from|copy|in)|third[- ]party(?: code)?[:,]|(?:imported|copied|taken|pulled|lifted)(?: verbatim| unmodified| unchanged| as is)?,? from (?:upstream|the )?|(?:local |modified )?(?:fork|copy|mirror) of (?:the )?upstream|upstream(?: source| version)?[:=]"
    r"|[\w.@/-]+ v?\d+(?:\.\d+)+ ?(?:-|\||,|\(c\)).*(?:\(c\)|copyright|licen[sc]e|\bmit\b|\bbsd\b|apache)|[\w.-]+@\d+(?:\.\d+)+\b)",
    re.I,
)
_NOT_MARK = re.compile(r"^\W*(?:hand-?written|detects?|emits?|checks?|callers?|writes?|marks?|skips?|ignores?|finds?|looks?|reads?|parses?|removes?|tests?|warns?|returns?|see)\b", re.I)
_GEN_NAME = re.compile(r"(?:^zz_generated|[._-](?:generated|autogen|gen)\.\w+$|_generated\.|\.g\.\w+$|\.pb\.\w+$|_pb2(?:_grpc)?\.pyi?$|\.designer\.\w+$|_string\.go$|\.grpc\.|^bindata\.go$|_gen\.\w+$|\.freezed\.|\.auto\.)", re.I)
_MIN_NAME = re.compile(r"(?:[.-]min\.(?:js|mjs|cjs|css)$|\.(?:bundle|chunk|packed|prod)(?:\.[0-9a-z]+)?\.js$)", re.I)
_HASHED = re.compile(r"^(?=[^.]*\d)[0-9a-z]{5,20}$")
_GEN_DIR = re.compile(r"^(?:generated|__generated__|gen|autogen|auto-?gen(?:erated)?|gen-src|gensrc|src-gen|codegen-out|generated-(?:src|sources)|\.generated|pb|genfiles)$", re.I)
_VEND_DIR = re.compile(r"^(?:vendor|vendored|third[-_]?party|3rdparty|node_modules|bower_components|externals?|extern|deps|site-packages|godeps|_vendor|contrib-upstream|.+-\d+(?:\.\d+){1,3})$", re.I)
_MODULE = re.compile(r"^/\* ?(?:module \d+:|\d+ ?\*/)|^//\# ?sourceMappingURL=|__webpack_require__|^\s*!function\(", re.M)
_DATA_LINE = re.compile(r"[\s\[{(]*+(?:\d+\s*:\s*)?[\[({]*+(?:(?:[bru]?\"[^\"\s]{16,}+\"|[bru]?'[^'\s]{16,}+'|-?(?:0x[0-9a-fA-F]++|[\d.]++(?:e-?\d+)?)\w{0,3})[\s\])}+]*+[,;]?\s*+[\[({]*+)++[\])}\s;,+]*+$")
_MASK = re.compile(r"\d+")
# What any announcement holds somewhere, in lower case; texts without it needn't be read line by line.
_ANNOUNCES = ("generat", "produced", "compiled", "emitted", "written", "created", "erzeugt", "generier", "erstellt", "génér", "gener", "generado", "gerado", "автоматич", "自动", "自動", "vendored", "third-party", "third party", "upstream", "copied", "imported", "taken", "pulled", "lifted", "copyright", "licen", "apache", "bsd", "mit", "(c)", "@")
# What any mark of a bundle holds.
_BUNDLES = ("/*", "sourceMappingURL=", "__webpack_require__", "!function(")


#: log likelihood of a content that shows no mark of a label
_UNMARKED = [0.0, -3.0, -4.0, -1.8, -4.5]


def evidence(path: str, content: bytes | None) -> list[float]:
    """Log potentials of the five labels for a file, from its name and content (the head, the end, and its whole shape).

    A label without any mark in a content loses by that (a copy bears none rather often); where there is no content only the name speaks.
    """
    e = _marks(path, content)
    if content and content.strip():
        e = [u if x == 0 else x for x, u in zip(e, _UNMARKED)]
    return e


def _marks(path: str, content: bytes | None) -> list[float]:
    e = [0.0] * 5
    name = path.rsplit("/", 1)[-1]
    parts = name.split(".")
    if _GEN_NAME.search(name):
        e[GEN] += 6.5
    if _MIN_NAME.search(name):
        e[MIN] += 7.0
    if len(parts) >= 3 and parts[-1] in ("js", "mjs", "cjs") and any(_HASHED.match(p) for p in parts[1:-1]):
        e[MIN] += 7.0
    if not content:
        return e
    text = content.decode("utf-8", "replace").lstrip("﻿")
    lines = text.splitlines()
    full = [x for x in lines if x.strip()]
    if not full:
        return e
    # announcements: in any comment line, the further behind the less they say about the whole file
    low = text.lower()
    if any(x in low for x in _ANNOUNCES):
        seen = 0
        for x in lines:
            s = x.strip()
            if not s:
                continue
            is_comment = s[:1] in "/#*;" or s[:2] in ("--", "<!") or s[:3] in ('"""', "'''")
            if not is_comment:
                seen += 1
                continue
            body = _COMMENT.match(s)[1]
            if body and not _NOT_MARK.match(body):
                if _GENERATED.match(body) or _FOREIGN.match(body):
                    e[GEN] += 9.0 if seen <= 25 else max(3.0, 9.0 * 25 / seen)
                    break
                if _VENDORED.match(body):
                    e[VEND] += 8.0 if seen <= 3 else max(1.0, 8.0 * 3 / seen)
                    break
    for x in full[-3:]:
        s = x.strip()
        body = _COMMENT.match(s)[1]
        if s[:1] in "/#*" and body and not _NOT_MARK.match(body) and (_TRAILER.match(body) or _GENERATED.match(body) or _FOREIGN.match(body)):
            e[GEN] += 8.0
            break
    # shape
    n = len(text)
    code = [x for x in full if x.strip()[:1] not in "*#" and x.strip()[:2] not in ("//", "/*")]
    longest = max((len(x) for x in code), default=0)
    spaces = sum(x.count(" ") + x.count("\t") for x in code) / max(1, sum(map(len, code)))
    if longest > 250 and code:
        packed = sum(len(x) for x in code if len(x) > 180) / max(1, sum(map(len, code)))
        words = sum(len(x) > 180 and x.count(",") + x.count(";") + x.count("{") > len(x) / 60 for x in code)
        if packed > 0.5 and spaces < 0.09 and words:
            e[MIN] += 7.5
    if any(x in text for x in _BUNDLES) and _MODULE.search(text):
        e[MIN] += 2.5
    digits = sum(map(text.count, "0123456789"))
    sparse = digits > 0.12 * n or spaces < 0.12 or text.count('"') + text.count("'") > len(full)
    data = sum(1 for x in full if _DATA_LINE.match(x)) if sparse else 0
    share = data / len(full)
    if len(full) >= 4 and (share > 0.7 or share > 0.5 and digits > 0.3 * n):
        e[BLOB] += 9.5 * min(1.0, n / 600)  # a short table says less
    elif digits > 0.3 * n and spaces < 0.35:
        e[BLOB] += 7.5 * min(1.0, n / 900)
    elif any(len(x) > 400 and re.search(r"[\"'`][A-Za-z0-9+/=_-]{300,}[\"'`]", x) for x in code):
        e[BLOB] += 7.5
    # mechanical text: neighbouring lines that differ in digits only; people write such too, so its neighbourhood decides
    masked = [_MASK.sub("0", x.strip()) for x in code]
    same = sum(a == b and "0" in a for a, b in zip(masked, masked[1:]))
    if same >= 2 and len(code) >= 5 and e[BLOB] == 0:
        e[GEN] += MECHANICAL if same >= 0.08 * len(code) else 1.0
    return e


def fingerprint(content: bytes | None) -> tuple[bytes | None, int]:
    """Hash of a text without leading comments, line ends, blanks and mark, so that copies meet, and its length; (None, 0) without text."""
    if not content:
        return None, 0
    text = content.decode("utf-8", "replace").lstrip("\ufeff")
    body = "\n".join(x for x in (y.strip() for y in text.splitlines()) if x and x[:2] not in ("//", "/*") and x[:1] not in "*#")
    return (hashlib.blake2b(body.encode(), digest_size=12).digest(), len(body)) if body else (None, 0)


def siblings_of(name: str) -> str:
    """What files of one directory that belong together have in common: the first word of the name and the extension."""
    stem, _, ext = name.partition(".")
    return f"{_FIRST_WORD.match(stem)[0].lower()}.{ext.rsplit('.', 1)[-1].lower()}"


_FIRST_WORD = re.compile(r"[^\W\d_]*")


def directory_evidence(name: str) -> list[float]:
    """Log potentials of the labels for a directory, from its name alone; whole names only."""
    e = [0.0] * 5
    if _GEN_DIR.match(name):
        e[GEN] += DIR_WEIGHT
    if _VEND_DIR.match(name):
        e[VEND] += DIR_WEIGHT
    return e


# ---------------------------------------------------------------- propagation


def _normed(row: list[float]) -> list[float]:
    """Log probabilities: a child without evidence then says nothing about its directory."""
    z = math.log(sum(map(math.exp, row)))
    return [x - z for x in row]


#: log potentials of a repository's root: nearly all are hand-written
_ROOT = [0.0, -5.5, -6.0, -5.5, -6.5]
#: log compatibility of a directory's label (row) with a child directory's and a child file's (column): children mostly are
#: what their directory is; other things appear among hand-written ones now and then, hardly ever the other way round
_DIR_DIR = [_normed(r) for r in [_ROOT] + [[0.0 if a == b else -7.0 if a in (GEN, VEND) else -3.0 for b in range(5)] for a in range(1, 5)]]
_DIR_FILE = [_normed(r) for r in [[0.0, -3.5, -4.2, -4.2, -4.8]] + [[0.0 if a == b else -7.0 if a in (GEN, VEND) else -1.5 if b == HAND else -3.0 for b in range(5)] for a in range(1, 5)]]


#: log compatibility of a group of siblings (row) with each of its files: they mostly are alike
_GROUP_FILE = [_normed([0.0 if a == b else -2.5 for b in range(5)]) for a in range(5)]

E, B, M, P = ([f"{x}{i}" for i in range(5)] for x in "ebmp")
MOST_DIRECTORIES = 50_000  # of a subtree that is passed over in one task


def _passed(terms: list[str], table: list[list[float]], up: bool) -> str:
    """SQL of an array: log sum over the sender's labels of exp(term + compatibility), per label of the receiver.

    up: the sender is the child, a column of the table.
    """
    rows = [list(r) for r in zip(*table)] if up else table
    to = ", ".join("array(" + ", ".join(f"{rows[x][y]}D" for x in range(5)) + ")" for y in range(5))
    t = f"array({', '.join(terms)})"
    return f"transform(array({to}), c -> array_max({t}) + ln(aggregate(zip_with({t}, c, (x, y) -> exp(x + y - array_max({t}))), 0D, (s, v) -> s + v)))"


def _spread(array: str, names: list[str]) -> list:
    return [F.col(array)[i].alias(n) for i, n in enumerate(names)]


def _log_sum(terms: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per row and label y: log sum over x of exp(terms[x] + table[x][y])."""
    t = terms[:, :, None] + table[None, :, :]
    top = t.max(axis=1)
    return top + np.log(np.exp(t - top[:, None, :]).sum(axis=1))


_DOWN = np.array(_DIR_DIR)


def _pass_over(depth: np.ndarray, parent: np.ndarray, own: np.ndarray, into: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of the directories of a subtree and the message of its root (the one without a parent in it).

    own: potentials with what files say; parent: row of the parent or -1; into: what the root hears from above.
    """
    b, said = own.copy(), np.zeros_like(own)
    levels = [np.flatnonzero(depth == d) for d in np.unique(depth)]
    for at in reversed(levels):
        said[at] = _log_sum(b[at], _DOWN.T)
        inner = at[parent[at] >= 0]
        np.add.at(b, parent[inner], said[inner])
    root = np.flatnonzero(parent < 0)
    up = said[root].copy()
    if into is not None:
        b[root] += into
    for at in levels:
        inner = at[parent[at] >= 0]
        if len(inner):
            b[inner] += _log_sum(b[parent[inner]] - said[inner], _DOWN)
    return b, up


def _subtree(p: pd.DataFrame, heard: bool):
    rows = {d: i for i, d in enumerate(p["dir"])}
    parent = np.array([-1 if d == r else rows.get(q, -1) for d, q, r in zip(p["dir"], p["parent"], p["block"])], dtype=np.int64)
    into = None
    root = int(np.flatnonzero(parent < 0)[0])
    if heard and not np.isnan(p["h0"].iloc[root]):
        into = p.loc[p.index[root], [f"h{i}" for i in range(5)]].to_numpy(dtype=float)
    b, up = _pass_over(p["depth"].to_numpy(), parent, p[B].to_numpy(dtype=float), into)
    return p, b, up, root


def _block_says(p: pd.DataFrame) -> pd.DataFrame:
    p, _, up, root = _subtree(p, False)
    return pd.DataFrame([[p["parent"].iloc[root], *up[0]]], columns=["at", *M])


def _block_beliefs(p: pd.DataFrame) -> pd.DataFrame:
    p, b, _, _ = _subtree(p, True)
    return pd.concat([p[["dir"]].reset_index(drop=True), pd.DataFrame(b, columns=B)], axis=1)


def _directories(ws: Workspace, node: DataFrame, most: int) -> DataFrame:
    """(dir, b0..b4): beliefs of all directories; node: (dir, parent, depth, b0..b4) with potentials and what files say.

    Subtrees of up to `most` directories are passed over as a whole, each in one task, so the number of jobs doesn't
    depend on how deep paths are. Only directories above larger subtrees (at most depth / most of all) go level by level.
    """
    segs = F.split("dir", "/")
    above = node.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda k: F.array_join(F.slice(segs, 1, k), "/"))).alias("top"))
    small = above.groupBy("top").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") <= most).select("top")
    # a small subtree has at most `most` rows here, so this join has no hot key
    block = above.join(small, "top").groupBy("dir").agg(F.min(F.struct(F.length("top").alias("n"), "top")).alias("b")).select("dir", F.col("b.top").alias("block"))
    node = ws.write(node.join(block, "dir", "left"))
    inside, top = node.filter(F.col("block").isNotNull()), node.filter(F.col("block").isNull())
    none = [F.lit(None).cast("double").alias(f"h{i}") for i in range(5)]
    out = ", ".join(["dir string", *[f"{x} double" for x in B]])
    deepest = top.agg(F.max("depth")).first()[0]
    if deepest is None:
        return inside.select("dir", "parent", "depth", "block", *B, *none).groupBy("block").applyInPandas(_block_beliefs, out)
    said = inside.groupBy("block").applyInPandas(_block_says, ", ".join(["at string", *[f"{x} double" for x in M]]))
    said = ws.write(said.groupBy("at").agg(*[F.sum(x).alias(x) for x in M]))
    # up and down the few directories that are left
    levels, below = {}, None
    for d in range(deepest, 0, -1):
        own = top.filter(F.col("depth") == d).join(said, F.col("dir") == F.col("at"), "left").select("dir", "parent", "depth", *[(F.col(b) + F.coalesce(m, F.lit(0.0))).alias(b) for b, m in zip(B, M)])
        if below is not None:
            got = below.groupBy("parent").agg(*[F.sum(m).alias(m) for m in M]).withColumnRenamed("parent", "at")
            own = own.join(got, F.col("dir") == F.col("at"), "left").select("dir", "parent", "depth", *[(F.col(b) + F.coalesce(m, F.lit(0.0))).alias(b) for b, m in zip(B, M)])
        own = own.withColumn("_m", F.expr(_passed(B, _DIR_DIR, True))).select("dir", "parent", "depth", *B, *_spread("_m", M))
        levels[d] = below = ws.write(own)
    done, heard = None, lambda up, own: (  # what a child hears from its parent leaves out what it said itself
        own.join(up.select(F.col("dir").alias("at"), *[F.col(b).alias(x) for b, x in zip(B, P)]), F.col("parent") == F.col("at")).withColumn("_h", F.expr(_passed([f"{x} - {m}" for x, m in zip(P, M)], _DIR_DIR, False)))
    )
    for d in range(1, deepest + 1):
        full = levels[d].select("dir", *B) if d == 1 else heard(over, levels[d]).select("dir", *[(F.col(b) + F.col("_h")[i]).alias(b) for i, b in enumerate(B)])
        over = ws.write(full)
        done = over if done is None else done.unionByName(over)
    roots = inside.filter((F.col("dir") == F.col("block")) & F.col("parent").isNotNull())
    alone = inside.groupBy("block").applyInPandas(_root_says, ", ".join(["block string", "parent string", *[f"{x} double" for x in M]])).filter(F.col("parent").isNotNull())
    into = heard(done, alone.join(roots.select("block").distinct(), "block", "left_semi")).select("block", *_spread("_h", [f"h{i}" for i in range(5)]))
    rest = inside.select("dir", "parent", "depth", "block", *B).join(into, "block", "left").groupBy("block").applyInPandas(_block_beliefs, out)
    return done.unionByName(ws.write(rest))


def _root_says(p: pd.DataFrame) -> pd.DataFrame:
    p, _, up, root = _subtree(p, False)
    return pd.DataFrame([[p["block"].iloc[0], p["parent"].iloc[root], *up[0]]], columns=["block", "parent", *M])


def classify(files: DataFrame, most_directories: int = MOST_DIRECTORIES, salts: int = 32) -> DataFrame:
    """(source_id, label, p_handwritten) of every distinct non-NULL id: the likeliest of the five labels.

    A factor tree per repository: files are leaves, files of a directory whose names begin alike form a group of
    siblings under it, directories are inner nodes. Leaves have potentials from name, content and copies in other
    repositories; directories from their names; parents and siblings speak through compatibilities. Messages go up to
    the root and down again; a node receives the sum of its children's log messages, so one with any number of files is
    aggregated partially, never gathered, and joins back to busy directories, groups and texts are salted. On a tree the
    beliefs are exact after both passes.

    Rows of one id: the potentials are averaged; content NULL leaves the name and the neighbours. A text found in
    several repositories counts as a copy, the less the shorter it is; not so where it was first: the earliest ingested
    file among those that neither a mark nor a directory calls a copy, and others in that repository. Tables without
    rows give none.
    """
    spark = files.sparkSession
    ws = Workspace(spark, "provenance")
    src = files.filter(F.col("id").isNotNull()).select("id", "content", F.col("ingested_at") if "ingested_at" in files.columns else F.lit(None).cast("timestamp").alias("ingested_at"))

    def run(batches):
        for b in batches:
            ids, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            ev = [evidence(i, c) for i, c in zip(ids, contents)]
            marks = [fingerprint(c) for c in contents]
            arrays = [b.column(0), b.column(2), pa.array([siblings_of(i.rsplit("/", 1)[-1]) for i in ids]), pa.array([m[0] for m in marks], pa.binary()), pa.array([m[1] for m in marks], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array([x[k] for x in ev], pa.float64()) for k in range(5)]], names=["id", "ingested_at", "alike", "print", "size", *E])

    made = src.mapInArrow(run, f"id string, ingested_at {src.schema['ingested_at'].dataType.simpleString()}, alike string, print binary, size long, " + ", ".join(f"{c} double" for c in E))
    dir_ = F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]*$", "")).otherwise(F.lit(""))
    made = made.withColumn("dir", dir_).withColumn("repo", F.substring_index("id", "/", 1))
    called = F.exists(F.split(F.lower("dir"), "/"), lambda x: x.rlike(_VEND_DIR.pattern))
    seen = ws.write(made.withColumn("called", called | (F.col(f"e{VEND}") > 5)))
    total = seen.count()

    # texts in several repositories: one row per (text, repository) before the texts are counted
    first = F.min(F.when(~F.col("called"), F.struct(F.coalesce(F.col("ingested_at").cast("timestamp"), F.expr("TIMESTAMP '9999-01-01'")).alias("t"), "repo"))).alias("first")
    per = seen.filter(F.col("print").isNotNull()).groupBy("print", "repo").agg(first, F.count(F.lit(1)).alias("n"))
    copies = per.groupBy("print").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"), F.min("first").alias("first")).filter("repos > 1").select("print", "n", F.col("first.repo").alias("home"))
    copies = ws.write(copies)
    found = salted_join(seen.filter(F.col("print").isNotNull()), copies, "print", heavy_keys(copies, "print", "n", total), salts, "id")
    copied = found.select("id", F.when(F.col("called") | F.col("home").isNull() | (F.col("repo") != F.col("home")), COPIED * F.least(F.lit(1.0), F.col("size") / 300)).otherwise(0.0).alias("c"), F.lit(0).alias("k"))
    own = seen.select("id", "dir", "alike", *E, F.lit(0.0).alias("c"), F.lit(1).alias("k")).unionByName(copied, allowMissingColumns=True)
    leaf = own.groupBy("id").agg(F.max("dir").alias("dir"), F.max("alike").alias("alike"), *[F.avg(c).alias(c) for c in E], F.max("c").alias("c"))
    leaf = ws.write(leaf.select("id", "dir", "alike", *[(F.col(c) + F.col("c")).alias(c) if i == VEND else F.col(c) for i, c in enumerate(E)]))
    ws.drop(seen)
    ws.drop(copies)

    # files to groups of siblings (alone in its group a file is the group), groups to directories
    told = leaf.withColumn("_m", F.expr(_passed(E, _GROUP_FILE, True)))
    group = told.groupBy("dir", "alike").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in E], *[F.sum(F.col("_m")[i]).alias(f"s{i}") for i in range(5)])
    group = group.select("dir", "alike", "n", *[F.when(F.col("n") == 1, F.col(c)).otherwise(F.col(f"s{i}")).alias(f"g{i}") for i, c in enumerate(E)])
    G = [f"g{i}" for i in range(5)]
    group = ws.write(group.withColumn("_m", F.expr(_passed(G, _DIR_FILE, True))).select("dir", "alike", "n", *G, *_spread("_m", M)))
    up_leaf = group.groupBy("dir").agg(F.count(F.lit(1)).alias("groups"), *[F.sum(m).alias(m) for m in M])

    # directories with their depth; every ancestor of a file's directory once
    segs = F.split("dir", "/")
    dirs = group.select("dir").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda k: F.array_join(F.slice(segs, 1, k), "/"))).alias("dir")).distinct()
    last = F.lower(F.substring_index("dir", "/", -1))
    parent = F.when(F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", ""))
    root = ~F.col("dir").contains("/")
    named = {GEN: last.rlike(_GEN_DIR.pattern), VEND: last.rlike(_VEND_DIR.pattern)}
    pot = [F.when(root, F.lit(_ROOT[i])).when(named[i], DIR_WEIGHT).otherwise(0.0) if i in named else F.when(root, F.lit(_ROOT[i])).otherwise(0.0) for i in range(5)]
    node = dirs.select("dir", parent.alias("parent"), F.size(segs).alias("depth"), *[x.alias(f"d{i}") for i, x in enumerate(pot)]).join(up_leaf, "dir", "left")
    node = node.select("dir", "parent", "depth", *[(F.col(f"d{i}") + F.coalesce(m, F.lit(0.0))).alias(b) for i, (m, b) in enumerate(zip(M, B))])
    belief = ws.write(_directories(ws, node, most_directories))

    # and down: directories to groups, groups to files
    upper = belief.select("dir", *[F.col(b).alias(x) for b, x in zip(B, P)])
    busy = heavy_keys(up_leaf, "dir", "groups", total)
    down = salted_join(group, upper, "dir", busy, salts, "alike").withColumn("_h", F.expr(_passed([f"{x} - {m}" for x, m in zip(P, M)], _DIR_FILE, False)))
    down = ws.write(down.select(F.concat_ws("/", "dir", "alike").alias("g"), "n", *[(F.col(g) + F.col("_h")[i]).alias(g) for i, g in enumerate(G)]))
    crowded = heavy_keys(down, "g", "n", total)
    said = leaf.select("id", F.concat_ws("/", "dir", "alike").alias("g"), *E, F.expr(_passed(E, _GROUP_FILE, True)).alias("_m"))
    heard = salted_join(said, down, "g", crowded, salts, "id").withColumn("_h", F.expr(_passed([f"g{i} - _m[{i}]" for i in range(5)], _GROUP_FILE, False)))
    belief = heard.select("id", *[F.when(F.col("n") == 1, F.col(f"g{i}")).otherwise(F.col(f"e{i}") + F.col("_h")[i]).alias(b) for i, b in enumerate(B)])
    best = F.greatest(*B)
    label = F.coalesce(*[F.when(F.col(b) == best, LABELS[i]) for i, b in enumerate(B)])
    z = sum((F.exp(F.col(b) - best) for b in B), F.lit(0.0))
    return belief.select(F.col("id").alias("source_id"), label.alias("label"), (F.exp(F.col("b0") - best) / z).alias("p_handwritten"))
