"""Pattern languages of the query surface as anchored regular expressions: GLOB, LIKE, topic patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """GLOB (case-sensitive, * ? [...]) as a regular expression; a class that isn't closed is ordinary text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))) > 0:
            body = pattern[i + 1 : j]
            out.append("[" + ("^" if body[:1] == "^" else "") + body.lstrip("^").replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(col: Column, pattern: str) -> Column:
    return col.rlike(glob_regex(pattern))


def like_prefix(col: Column, prefix: str) -> Column:
    """The loose prefix match of SQL LIKE without escapes: ASCII case is ignored, _ and % are wildcards."""
    return col.ilike(prefix + "%")


def topic_regex(pattern: str) -> str:
    """Topic pattern over dot-separated segments: * is one segment, ** any number of them, none included."""
    if pattern == "**":
        return r"^.*$"
    segs, out = pattern.split("."), ""
    for i, s in enumerate(segs):
        first = i == 0
        if s == "**":
            out += r"(?:[^.]*(?:\.[^.]*)*\.)?" if first else r"(?:\.[^.]*)*"
            continue
        part = r"[^.]*" if s == "*" else re.escape(s)
        out += part if first or (i == 1 and segs[0] == "**") else r"\." + part
    return f"^{out}$"


def topic_matches(col: Column, pattern: str) -> Column:
    return col.rlike(topic_regex(pattern))


def strip_file_uri(col: Column) -> Column:
    """Removes one leading file:// and keeps the rest."""
    return F.regexp_replace(col, "^file://", "")
