"""Generalised LL recognition with a graph-structured stack.

A grammar is written in EBNF, compiled to slots, and run over token kinds. All viable alternatives are followed at once:
calls of one nonterminal at one position share a stack node, descriptors (slot, node, position) are done once, and what a
node returned is replayed to later callers. Brackets pair up in every derivation, so bracketed stretches are recognised from
the innermost outwards, each on its own level of tokens. Where one token of lookahead leaves a single alternative, the
parser simply goes on, so unambiguous stretches cost no descriptors. Several start symbols (dialects) run together on one stack.
"""

from __future__ import annotations

import re
from array import array

END = "<end>"
_TERM, _CALL, _TAIL, _RET, _PRED = range(5)
_PAIRS = {"'('": "')'", "'['": "']'", "'{'": "'}'", "INDENT": "DEDENT"}
MEMO_ENTRIES = 400_000
MEMO_BYTES = 4_000  # longer stretches hardly come again
_LEX = re.compile(r"\s*(?:\#[^\n]*|('(?:[^'\\]|\\.)+'|@?[A-Za-z_]\w*|[=|;()*+?]))")


class _Jump:
    """A rule that can only be the one token at hand."""


JUMP = _Jump()


def _or(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


class Grammar:
    """EBNF:  Name = 'literal' TOKENKIND Rule ( a | b )? c* d+ @newline ;   Upper-case-only names are token kinds.

    `@newline` is empty and holds only where a line break, a closing brace or the end comes next. Rules may be given
    again; the later text then adds alternatives (how dialects extend a base). An empty alternative is written by `?`.
    """

    def __init__(self, text: str, starts: tuple[str, ...], balanced: bool = True):
        """balanced: every bracket is a token of its own, so brackets pair up in whatever the grammar derives."""
        self.kinds: dict[str, int] = {END: 0}
        self.rules: dict[str, list[list[str]]] = {}
        self._read(text)
        self.starts = starts
        self.enclosed: set[str] = set()
        if balanced:
            self._enclose()
        self._compile()
        self.memo: dict[bytes, int] = {}
        self.classes: dict[int, int] = {}
        self.masks: list[int] = []
        self.openers: list[int] = []

    def _enclose(self) -> None:
        """Gives each bracketed stretch of an alternative a rule of its own.

        Such a rule spans from a bracket to its partner wherever it is called, and what it spans alone decides whether
        it holds. So it is recognised by itself, once per sequence of kinds, for all contexts and all texts of a worker.
        """
        made: dict[tuple[str, ...], str] = {}
        for name in list(self.rules):
            for alt in self.rules[name]:
                i = len(alt) - 1
                while i >= 0:
                    if alt[i] in _PAIRS:
                        j = alt.index(_PAIRS[alt[i]], i)
                        part = tuple(alt[i : j + 1])
                        if part not in made:
                            made[part] = self._new("enclosed", [list(part)])
                            self.enclosed.add(made[part])
                        alt[i : j + 1] = [made[part]]
                    i -= 1

    # -- reading
    def _read(self, text: str) -> None:
        toks = [t for t in _LEX.findall(text) if t]
        i = 0
        while i < len(toks):
            name = toks[i]
            assert toks[i + 1] == "=", (name, toks[i : i + 4])
            alts, i = self._alts(toks, i + 2, name)
            assert toks[i] == ";", (name, toks[i])
            self.rules.setdefault(name, []).extend(alts)
            i += 1

    def _new(self, name: str, alts: list[list[str]]) -> str:
        made = f"{name}.{len(self.rules)}"
        self.rules[made] = alts
        return made

    def _alts(self, toks: list[str], i: int, name: str) -> tuple[list[list[str]], int]:
        alts, cur = [], []
        while toks[i] not in (";", ")"):
            t = toks[i]
            if t == "|":
                alts.append(cur)
                cur = []
                i += 1
                continue
            if t == "(":
                inner, i = self._alts(toks, i + 1, name)
                assert toks[i] == ")", (name, toks[i])
                item = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._new(name, inner)
            else:
                item = t
            i += 1
            while toks[i] in ("*", "+", "?"):
                if toks[i] == "?":
                    item = self._new(name, [[item], []])
                else:
                    loop = self._new(name, [])
                    self.rules[loop] = [[item, loop], []]
                    if toks[i] == "+":
                        item = self._new(name, [[item, loop]])
                    else:
                        item = loop
                i += 1
            cur.append(item)
        return [*alts, cur], i

    # -- compiling
    def _compile(self) -> None:
        names = {n: k for k, n in enumerate(self.rules)}
        for alts in self.rules.values():
            for alt in alts:
                for s in alt:
                    if s not in names and s[0] != "@":
                        if s[0] != "'" and not s.isupper():
                            raise ValueError(f"no rule {s}")
                        self.kinds.setdefault(s.strip("'") if s[0] == "'" else s, len(self.kinds))
        kind = lambda s: self.kinds[s.strip("'") if s[0] == "'" else s]
        nullable: set[str] = set()
        first: dict[str, set[int]] = {n: set() for n in names}
        follow: dict[str, set[int]] = {n: set() for n in names}
        for s in self.starts:
            follow[s].add(0)
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for alt in alts:
                    for s in alt:
                        if s[0] == "@":
                            continue
                        got = first[s] if s in names else {kind(s)}
                        if not got <= first[n]:
                            first[n] |= got
                            changed = True
                        if s not in nullable:
                            break
                    else:
                        if n not in nullable:
                            nullable.add(n)
                            changed = True
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for alt in alts:
                    after = follow[n]
                    for s in reversed(alt):
                        if s[0] == "@":
                            continue
                        if s in names:
                            if not after <= follow[s]:
                                follow[s] |= after
                                changed = True
                            after = first[s] | after if s in nullable else first[s]
                        else:
                            after = {kind(s)}
        self.code: list[tuple[int, int]] = []
        self.select: list[dict[int, tuple[int, ...]]] = [{} for _ in names]
        self.starts_of: list[list[int]] = [[] for _ in names]
        self.empty_alts: set[int] = set()
        for n, alts in self.rules.items():
            table: dict[int, list[int]] = {}
            for alt in alts:
                start, heads, empty = len(self.code), set(), True
                for s in alt:
                    if s[0] == "@":
                        continue
                    heads |= first[s] if s in names else {kind(s)}
                    if s not in nullable:
                        empty = False
                        break
                self.starts_of[names[n]].append(start)
                if empty:
                    heads = heads | follow[n]
                    self.empty_alts.add(start)
                for i, s in enumerate(alt):
                    if s[0] == "@":
                        self.code.append((_PRED, 0))
                    elif s not in names:
                        self.code.append((_TERM, kind(s)))
                    elif i == len(alt) - 1:
                        self.code.append((_TAIL, names[s]))
                    else:
                        self.code.append((_CALL, names[s]))
                self.code.append((_RET, 0))
                for h in heads:
                    table.setdefault(h, []).append(start)
            self.select[names[n]] = {h: tuple(s) for h, s in table.items()}
        self.names = names
        self.by_number = list(names)
        self.bit = {names[x]: k for k, x in enumerate(sorted(self.enclosed))}
        plain = lambda x: self.kinds.get(x.strip("'"), -1)
        self.opens = {plain(a): plain(b) for a, b in _PAIRS.items() if plain(a) >= 0}
        self.closes = set(self.opens.values())
        self.close = self.kinds.get("}", -1)
        self._look_two_ahead(names, nullable, follow, kind)
        self.by_opener: dict[int, list[int]] = {k: [] for k in self.opens}
        for x in sorted(self.enclosed):
            self.by_opener[plain(self.rules[x][0][0])].append(names[x])

    def _look_two_ahead(self, names, nullable, follow, kind) -> None:
        """What the first two tokens say: per rule and alternative the kinds a with which it may be one token long, and
        for each first kind the kinds that may come second (as bit sets). Tables are filled from it as texts ask."""
        empty = (0, 0, 0, 0, {})  # first, alone (no predicate involved), perhaps alone, bracketed rules alone, second by first
        known = {n: empty for n in names}
        for n in self.enclosed:
            k = 1 << kind(self.rules[n][0][0])
            known[n] = (k, k, k, 1 << self.bit[names[n]], {})
        users: dict[str, set[str]] = {n: set() for n in names}
        for n, alts in self.rules.items():
            for alt in alts:
                for x in alt:
                    if x in names:
                        users[x].add(n)

        def of(alt: list[str]):
            first = alone = perhaps = bits = 0
            second: dict[int, int] = {}
            blank, sure = True, True  # whether the rest may be empty, and be so without a predicate
            for x in reversed(alt):
                if x[0] == "@":
                    sure = alone = bits = 0
                    continue
                if x not in names:
                    k = kind(x)
                    second = {k: first} if first else {}
                    alone, perhaps, bits = (1 << k if blank and sure else 0), (1 << k if blank else 0), 0
                    first, blank, sure = 1 << k, False, False
                    continue
                f, a, p, b, two = known[x]
                got = dict(two)
                if first:
                    rest, k = p, 0
                    while rest:
                        if rest & 1:
                            got[k] = got.get(k, 0) | first
                        rest >>= 1
                        k += 1
                if x in nullable:
                    for k, m in second.items():
                        got[k] = got.get(k, 0) | m
                clear = x in self.plainly_empty
                alone = (a if blank and sure else 0) | (alone if clear else 0)
                bits = (b if blank and sure else 0) | (bits if clear else 0)
                perhaps = (p if blank else 0) | (perhaps if x in nullable else 0)
                first = f | (first if x in nullable else 0)
                second, blank, sure = got, blank and x in nullable, sure and clear
            return first, alone, perhaps, bits, second

        self.plainly_empty = set()
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                if n not in self.plainly_empty and any(all(x in self.plainly_empty for x in alt) for alt in alts):
                    self.plainly_empty.add(n)
                    changed = True
        todo = [n for n in names if n not in self.enclosed]
        queued = set(todo)
        while todo:
            n = todo.pop()
            queued.discard(n)
            parts = [of(alt) for alt in self.rules[n]]
            second: dict[int, int] = {}
            for q in parts:
                for k, m in q[4].items():
                    second[k] = second.get(k, 0) | m
            made = tuple(_or(q[j] for q in parts) for j in range(4)) + (second,)
            if made != known[n]:
                known[n] = made
                for u in users[n]:
                    if u not in queued and u not in self.enclosed:
                        queued.add(u)
                        todo.append(u)
        self.two = [known[n] for n in names]
        self.two_of_alt = {}
        for n, alts in self.rules.items():
            for start, alt in zip(self.starts_of[names[n]], alts):
                self.two_of_alt[start] = of(alt)
        self.after = [_or(1 << k for k in follow[n]) for n in names]
        self.empty_numbers = {names[n] for n in nullable}
        self.table: list[dict] = [{} for _ in names]

    def _entry(self, rule: int, pair: int):
        """What to do with a rule at two tokens: the alternatives to follow, JUMP over one token, or () for none.

        For a bracketed stretch as first token instead of JUMP the bracketed rules (bits) that the rule derives alone.
        """
        total = len(self.kinds)
        nested, pair_ = divmod(pair, total * total)
        a, b = divmod(pair_, total)
        first, alone, perhaps, bits, second = self.two[rule]
        alts = self.select[rule].get(a, ())
        if alts and rule not in self.empty_numbers and rule not in self.bit and not second.get(a, 0) >> b & 1:
            if nested:
                if alone >> a & 1 or not perhaps >> a & 1:
                    made = bits
                    self.table[rule][pair] = made
                    return made
            elif alone >> a & 1:
                self.table[rule][pair] = JUMP
                return JUMP
            elif not perhaps >> a & 1:
                alts = ()
        keep = []
        for start in alts:
            f, _, p, _, two = self.two_of_alt[start]
            if not f >> a & 1 or two.get(a, 0) >> b & 1 or p >> a & 1 and self.after[rule] >> b & 1 or start in self.empty_alts:
                keep.append(start)
        self.table[rule][pair] = made = tuple(keep)
        return made

    def accepts(self, kinds: list[int], breaks: set[int] | frozenset = frozenset()) -> tuple[set[str], int]:
        """The start symbols that derive all of `kinds` (a list that ends with 0), and the furthest position reached.

        With brackets, the innermost stretches come first: what a stretch means to the text around it is only which
        bracketed rules derive it, so it then stands there as one token of that class. Depth costs no calls, every
        token is read at one level, and stretches that look alike on their own level are parsed once per worker.
        """
        cur = [2 * k + (i in breaks) for i, k in enumerate(kinds)] if breaks else [2 * k for k in kinds]
        if self.enclosed:
            opens, closes, base = self.opens, self.closes, len(self.kinds)
            flat, cur, outer = cur, [], []
            for i, k in enumerate(kinds):
                if k in opens:
                    outer.append((cur, opens[k]))
                    cur = [flat[i]]
                elif k in closes:
                    if not outer or outer[-1][1] != k:
                        return set(), i
                    cur.append(flat[i])
                    made = self._class_of(cur)
                    if made < 0:
                        return set(), i
                    fresh = cur[0] & 1
                    cur, _ = outer.pop()
                    cur.append(2 * (base + made) + fresh)
                else:
                    cur.append(flat[i])
            if outer:
                return set(), len(kinds) - 1
        numbers, far = self._run([self.names[x] for x in self.starts], cur, len(cur) - 1)
        return {self.by_number[x] for x in numbers}, far

    def _class_of(self, level: list[int]) -> int:
        """The class of a bracketed stretch: the set of bracketed rules that derive it, -1 if none does."""
        key = array("I", level).tobytes()
        known = self.memo.get(key)
        if known is None:
            found, _ = self._run(self.by_opener[level[0] >> 1], [*level, 0], len(level))
            known = -1
            if found:
                mask = sum(1 << self.bit[x] for x in found)
                known = self.classes.setdefault(mask, len(self.classes))
                if known == len(self.masks):
                    self.masks.append(mask)
                    self.openers.append(level[0] >> 1)
            if len(key) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[key] = known
        return known

    def _run(self, starts, level: list[int], end: int) -> tuple[set[int], int]:
        """Of the rules `starts` (numbers) those that derive level[:end], and the furthest position reached."""
        code, table, entry, close, bit, base = self.code, self.table, self._entry, self.close, self.bit, len(self.kinds)
        kinds, masks = [c >> 1 for c in level], None
        if max(kinds) >= base:
            masks = [self.masks[k - base] if k >= base else 0 for k in kinds]
            kinds = [self.openers[k - base] if k >= base else k for k in kinds]
            pairs = [(base if m else 0) * base + a * base + b for a, b, m in zip(kinds, [*kinds[1:], 0], masks)]
        else:
            pairs = [a * base + b for a, b in zip(kinds, [*kinds[1:], 0])]
        # a node: [return slot, its node, further (slot, node) pairs, the same as a set, first return, all returns]
        nodes: dict[int, list] = {}
        rules = len(table)
        todo: list[tuple[int, list, int]] = []
        seen: set[tuple[int, int, int]] = set()
        found, far = set(), 0
        for x in starts:
            root = [-1, x, None, None, -1, None]
            nodes[x] = root
            for s in self.select[x].get(kinds[0], ()):
                todo.append((s, root, 0))
        while todo:
            s, u, i = todo.pop()
            while True:
                op, arg = code[s]
                if op == _TERM:
                    if kinds[i] != arg or masks and masks[i]:
                        break
                    i += 1
                    s += 1
                    continue
                if op == _RET:
                    if u[4] < 0:
                        u[4] = i
                    elif u[4] == i:
                        break
                    else:
                        done = u[5]
                        if done is None:
                            u[5] = {u[4], i}
                        elif i in done:
                            break
                        else:
                            done.add(i)
                    if u[2] is None:
                        s = u[0]
                        if s < 0:
                            if i == end:
                                found.add(u[1])
                            break
                        u = u[1]
                        continue
                    if u[0] < 0:
                        if i == end:
                            found.add(u[1])
                    else:
                        key = (u[0], id(u[1]), i)
                        if key not in seen:
                            seen.add(key)
                            todo.append((u[0], u[1], i))
                    for r, v in u[2]:
                        key = (r, id(v), i)
                        if key not in seen:
                            seen.add(key)
                            todo.append((r, v, i))
                    break
                if op == _PRED:
                    if level[i] & 1 or kinds[i] == close or not kinds[i]:
                        s += 1
                        continue
                    break
                if arg in bit:
                    if masks and masks[i] >> bit[arg] & 1:
                        i += 1
                        s += 1
                        continue
                    break
                alts = table[arg].get(pairs[i])
                if alts is None:
                    alts = entry(arg, pairs[i])
                if alts is JUMP:
                    i += 1
                    s += 1
                    continue
                if not alts:
                    break
                if alts.__class__ is int:
                    if masks[i] & alts:
                        i += 1
                        s += 1
                        continue
                    break
                if op == _CALL:
                    key = i * rules + arg
                    v = nodes.get(key)
                    if v is not None:
                        r = s + 1
                        if v[0] == r and v[1] is u:
                            break
                        edge = (r, id(u))
                        if v[2] is None:
                            v[2], v[3] = [(r, u)], {edge}
                        elif edge in v[3]:
                            break
                        else:
                            v[2].append((r, u))
                            v[3].add(edge)
                        if v[4] >= 0:
                            for j in v[5] or (v[4],):
                                k = (r, id(u), j)
                                if k not in seen:
                                    seen.add(k)
                                    todo.append((r, u, j))
                        break
                    nodes[key] = v = [s + 1, u, None, None, -1, None]
                    u = v
                if len(alts) > 1:
                    for a in alts[1:]:
                        key = (a, id(u), i)
                        if key not in seen:
                            seen.add(key)
                            todo.append((a, u, i))
                    key = (alts[0], id(u), i)
                    if key in seen:
                        break
                    seen.add(key)
                s = alts[0]
            if i > far:
                far = i
        return found, far
