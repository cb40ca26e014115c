"""A small packrat parser over bytes: parsing expressions with regular-expression terminals and semantic actions.

An expression is a function (state, position) -> end position, or -1. Rules remember their result per position, so a
rule is tried at most once anywhere and the time stays linear in the text. What actions emitted in a branch that fails is
taken back. Positions are byte offsets of the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Expr = Callable[["State", int], int]


class State:
    """One parse: the text, what rules returned where, what actions emitted, and from where on something never closes."""

    __slots__ = ("text", "memo", "out", "never", "lines")

    def __init__(self, text: bytes):
        self.text, self.memo, self.out, self.never, self.lines = text, {}, [], {}, None


def term(pattern: bytes, flags: int = 0) -> Expr:
    match = re.compile(pattern, flags | re.S).match

    def run(s: State, i: int) -> int:
        m = match(s.text, i)
        return m.end() if m else -1

    return run


def closed(pattern: bytes) -> Expr:
    """A text with an end mark that may lie far away (a comment, a string of many lines).

    Whether a mark ends such a text doesn't depend on where the text began. So once one is found never to end, those
    behind it needn't be looked at, and a file of nothing but openings costs one pass.
    """
    match, key = re.compile(pattern, re.S).match, object()

    def run(s: State, i: int) -> int:
        if i >= s.never.get(key, i + 1):
            return -1
        m = match(s.text, i)
        return m.end() if m else -1

    def watched(s: State, i: int) -> int:
        j = run(s, i)
        if j < 0 and opening(s.text, i):
            s.never.setdefault(key, i)
        return j

    opening = re.compile(re.match(rb"(?:\\.|[^(\\\[])+", pattern)[0], re.S).match
    return watched


def seq(*parts: Expr) -> Expr:
    def run(s: State, i: int) -> int:
        for p in parts:
            i = p(s, i)
            if i < 0:
                return -1
        return i

    return run


def choice(*parts: Expr) -> Expr:
    def run(s: State, i: int) -> int:
        n = len(s.out)
        for p in parts:
            j = p(s, i)
            if j >= 0:
                return j
            del s.out[n:]
        return -1

    return run


def star(part: Expr, least: int = 0) -> Expr:
    def run(s: State, i: int) -> int:
        n = 0
        while True:
            held = len(s.out)
            j = part(s, i)
            if j < 0 or j == i:
                del s.out[held:]
                return i if n >= least else -1
            i, n = j, n + 1

    return run


def opt(part: Expr) -> Expr:
    def run(s: State, i: int) -> int:
        n = len(s.out)
        j = part(s, i)
        if j < 0:
            del s.out[n:]
            return i
        return j

    return run


def ahead(part: Expr) -> Expr:
    return lambda s, i: i if part(s, i) >= 0 else -1


def unless(part: Expr) -> Expr:
    return lambda s, i: -1 if part(s, i) >= 0 else i


def at_line_start(s: State, i: int) -> int:
    """Succeeds where only blanks (or a byte order mark) stand before i on its line."""
    t, j = s.text, i - 1
    while j >= 0 and t[j] in b" \t\xef\xbb\xbf":
        j -= 1
    return i if j < 0 or t[j] == 10 else -1


def rule(part: Expr) -> Expr:
    """Packrat: the end position of this expression at a place is computed once. Only for parts without actions."""
    key = object()

    def run(s: State, i: int) -> int:
        k = (key, i)
        j = s.memo.get(k)
        if j is None:
            j = s.memo[k] = part(s, i)
        return j

    return run


def act(part: Expr, then: Callable[[State, int, int], None]) -> Expr:
    """Runs `then` with the extent of a match."""

    def run(s: State, i: int) -> int:
        j = part(s, i)
        if j >= 0:
            then(s, i, j)
        return j

    return run
