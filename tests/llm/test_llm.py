"""Operators for training text: grammars, propagation, encoding, mixing, scoring."""

import ast
import random
from array import array
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import docpairs as D
from lodestrata.llm import grammars as G
from lodestrata.llm import mixing as M
from lodestrata.llm import provenance as P
from lodestrata.llm import syntax as S
from lodestrata.llm import tokens as T
from lodestrata.llm import toxicity as X
from lodestrata.llm.gll import Grammar

FILES = "id string, language string, content binary, path string, source_id string, description string, row int"


def files(spark, rows):
    return spark.createDataFrame([(i, lang, None if c is None else bytearray(c), i, "clash", "clash", 1) for i, lang, c in rows], FILES)


# ---------------------------------------------------------------- p1


@pytest.mark.parametrize(
    "language, text, row, documented",
    [
        ("go", "package a\n\n// Load reads the whole index into memory.\nfunc Load() {}\n", 3, True),
        ("go", "package a\n\n// Load.\nfunc Load() {}\n", 3, False),
        ("go", "package a\n\n// Reads the index into memory.\n\nfunc Load() {}\n", 4, False),
        ("go", "package a\n\n//go:noinline\nfunc Load() {}\n", 3, False),
        ("go", "package a\n\n// old := load(a, 1)\n// if old { return }\nfunc Load() {}\n", 4, False),
        ("go", "package a\n\nvar s = `\n// Reads the index into memory.\n`\nfunc Load() {}\n", 5, False),
        ("go", "package a\n\nvar x = 1 // keeps the old value\nfunc Load() {}\n", 3, False),
        ("rust", "/// Idempotent.\n#[inline]\npub fn go() {}\n", 2, True),
        ("rust", '#[doc = "Frees the arena."]\nfn go() {}\n', 1, True),
        ("rust", "#[inline]\nfn go() {}\n", 1, False),
        ("python", 'def f(a):\n    """Gives up after three attempts."""\n    return a\n', 0, True),
        ("python", 'def f(a):\n    # note\n    """Gives up after three attempts."""\n', 0, True),
        ("python", 'def f(a):\n    """TODO: document"""\n    return a\n', 0, False),
        ("python", "# Gives up after three attempts.\n@cached\ndef f(a):\n    return a\n", 2, True),
        ("python", 'def f(a):\n    x = """Gives up after three attempts."""\n', 0, False),
        ("js", "/**\n * @param a\n * @returns\n */\nfunction f(a) {}\n", 4, False),
        ("js", "/**\n * @param a the oldest entry to keep\n */\nexport function f(a) {}\n", 3, True),
        ("js", "// Overlapping ranges are merged.\r\nfunction f(a) {}\r\n", 1, True),
        ("java", "class A {\n  /** Ignores empty input. */\n  @Override\n  public int f() { return 0; }\n}\n", 3, True),
        ("java", "class A {\n  /** {@inheritDoc} */\n  public int f() { return 0; }\n}\n", 2, False),
        ("c", "/*\n * 合并重叠的区间\n */\nint f(void) { return 0; }\n", 3, True),
        ("bash", "#!/bin/sh\n# Not safe for concurrent use.\nf() {\n  :\n}\n", 2, True),
        ("bash", "cat <<'E'\n# Not safe for concurrent use.\nE\nf() {\n  :\n}\n", 3, False),
    ],
)
def test_documentation(language, text, row, documented):
    assert (row in {r for r, *_ in D.documented(text.encode(), language)}) == documented


def test_documented_functions_join_and_dirt(spark):
    text = "﻿package a\n\n// Load reads the index into memory.\nfunc Load() {}\n".encode()
    at = text.index(b"func")
    nodes = [("n", "r/a.go", "function_declaration", at, len(text) - 1, 3), ("n", "r/a.go", "function_declaration", at, len(text) - 1, 3), ("m", "r/a.go", "function_declaration", at + 4, len(text), 3), (None, "r/a.go", "function_declaration", at, 99, 3), ("q", None, "function_declaration", at, 99, 3), ("c", "r/a.go", "call_expression", at, 99, 3), ("z", "r/a.go", "function_declaration", None, None, None)]
    a = spark.createDataFrame([(*r, 1, "x") for r in nodes], "node_id string, source_id string, node_kind string, start_byte long, end_byte long, start_row long, lo int, description string")
    f = files(spark, [("r/a.go", "go", text), ("r/a.go", "go", text), ("r/n.go", "go", None), ("r/e.go", "go", b""), (None, "go", text), ("r/x.unknown", None, text), ("r/bad.py", "python", b"\xff\xfe\x00def f(")])
    assert [r.node_id for r in D.documented_functions(f, a).collect()] == ["n"]
    sym = spark.createDataFrame([("n", "func Load()", 1), ("n", "", 2), (None, "x", 3)], "node_id string, detail string, code int")
    row = D.pairs(f, a, sym).first()
    assert (row.signature, row.code, row.description) == ("func Load()", "func Load() {}", "Load reads the index into memory.")
    assert D.documented_functions(f.limit(0), a.limit(0)).count() == 0


def test_long_files_stay_linear():
    text = b"package a\n" + b"// The sentence says something.\nfunc F() {}\n\n" * 20_000
    assert len(D.documented(text, "go")) == 20_000


# ---------------------------------------------------------------- p2


def test_propagation_labels(spark):
    plain = b"package a\n\nfunc F(a int) error {\n\tdefer load(a)\n\treturn nil\n}\n"
    lib = ("package b\n" + "\n".join(f"func G{i}(x int) int {{ return step(x, {i * 7 % 5}) }}" for i in range(12))).encode()
    rows = [("r/src/a.go", "go", plain), ("r/gen/b.go", "go", plain + b"// x\n"), ("r/x/c.pb.go", "go", plain), ("r/x/d.go", "go", b"// Code generated by tool v1. DO NOT EDIT.\n" + plain), ("r/x/e.go", "go", b"// Detects files marked as generated by tools.\n" + plain)]
    rows += [("r/x/f.min.js", "js", b"var a=1;" * 200), ("r/x/n.go", "go", None), ("r/vendor/l/n.go", "go", None), ("r/vendors/p.go", "go", plain), (None, "go", plain), ("r/x/empty.go", "go", b"")]
    rows += [("r/x/data.py", "python", b"D = [\n" + b"    0x12, 0x34, 0x56, 0x78, 0x9a, 0xbc,\n" * 40 + b"]\n"), ("q/third_party/l/l.go", "go", lib), ("s/src/l.go", "go", b"// Copied from upstream\n" + lib), ("r/src/a.go", "go", plain), ("top.go", "go", plain)]
    got = {r.source_id: r.label for r in P.classify(files(spark, rows)).collect()}
    assert got == {
        "r/src/a.go": "handwritten", "r/gen/b.go": "generated", "r/x/c.pb.go": "generated", "r/x/d.go": "generated", "r/x/e.go": "handwritten", "r/x/f.min.js": "minified", "r/x/n.go": "handwritten", "r/vendor/l/n.go": "vendored",
        "r/vendors/p.go": "handwritten", "r/x/empty.go": "handwritten", "r/x/data.py": "blob", "q/third_party/l/l.go": "vendored", "s/src/l.go": "vendored", "top.go": "handwritten",
    }
    assert P.classify(files(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("most", [50_000, 2, 1, 0])
def test_propagation_is_exact_on_a_tree(spark, most):
    """Beliefs of a small tree equal the sums over all labellings, in whatever blocks its directories are passed over."""
    import itertools
    import math

    ids = ["r/gen/a1.go", "r/gen/a2.go", "r/c.go", "r/x/y/d.go"]
    ev = {i: P.evidence(i, b"package a\n") for i in ids}
    dirs = {"r": P.directory_evidence(""), "r/gen": P.directory_evidence("gen"), "r/x": P.directory_evidence("x"), "r/x/y": P.directory_evidence("y")}
    e = lambda table: np.exp(np.array(table))
    pot = {k: e(v) for k, v in (ev | dirs).items()}
    want = {}
    for i in ids:
        w = [0.0] * 5
        for r, g, x, y, group, f in itertools.product(range(5), repeat=6):
            base = math.exp(P._ROOT[r]) * pot["r"][r] * pot["r/gen"][g] * pot["r/x"][x] * pot["r/x/y"][y] * math.exp(P._DIR_DIR[r][g] + P._DIR_DIR[r][x] + P._DIR_DIR[x][y] + P._DIR_FILE[g][group])
            leaf = {
                "r/gen/a1.go": lambda v: math.exp(P._GROUP_FILE[group][v]) * pot["r/gen/a1.go"][v], "r/gen/a2.go": lambda v: math.exp(P._GROUP_FILE[group][v]) * pot["r/gen/a2.go"][v],
                "r/c.go": lambda v: math.exp(P._DIR_FILE[r][v]) * pot["r/c.go"][v], "r/x/y/d.go": lambda v: math.exp(P._DIR_FILE[y][v]) * pot["r/x/y/d.go"][v],
            }
            for k, m in leaf.items():
                base *= m(f) if k == i else sum(map(m, range(5)))
            w[f] += base
        want[i] = w[0] / sum(w)
    got = {r.source_id: r.p_handwritten for r in P.classify(files(spark, [(i, "go", b"package a\n") for i in ids]), most_directories=most).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_neighbours_decide_what_files_leave_open(spark):
    """Files without content or with weak marks follow their directory and their siblings."""
    plain = b"package a\n\nfunc F(a int) error {\n\tdefer load(a)\n\treturn nil\n}\n"
    marked = b"// Code generated by tool v1. DO NOT EDIT.\n" + plain
    mechanical = b"package a\n\nfunc F() {\n" + b"".join(b"\ts.f%d = %d\n" % (i, 3 * i) for i in range(6)) + b"}\n"
    rows = [(f"r/x/user{i}.go", "go", marked) for i in range(4)] + [("r/x/user9.go", "go", None), ("r/x/other.go", "go", None), ("r/x/user_own.go", "go", plain)]
    rows += [("r/a/m.go", "go", mechanical), ("r/gen/m.go", "go", mechanical), *[(f"r/a/p{i}.go", "go", plain + b"// %d" % i) for i in range(5)]]
    got = {r.source_id: r.label for r in P.classify(files(spark, rows)).collect()}
    assert got["r/x/user9.go"] == "generated" and got["r/x/other.go"] == "handwritten" and got["r/x/user_own.go"] == "handwritten"
    assert got["r/a/m.go"] == "handwritten" and got["r/gen/m.go"] == "generated"


def test_marks_anywhere_and_the_first_copy(spark):
    mark = b"// Code generated by tool v1. DO NOT EDIT.\n"
    far = b"".join(b"%s(a, load(b));\n" % (b"abcdefg"[i % 7 : i % 7 + 1] * (1 + i % 5)) for i in range(300))
    g = lambda t: P._marks("r/a.c", t)[P.GEN]
    assert g(mark + far) > g(b"\n".join(far.split(b"\n")[:40]) + b"\n" + mark + far) > g(far + mark + far) > 2
    lib = ("package b\n" + "\n".join(f"func G{i}(x int) int {{ return step(x, {i * 7 % 5}) }}" for i in range(12))).encode()
    rows = [("author/src/l.go", lib, 1), ("author/old/l.go", lib, 5), ("q/third_party/l/l.go", lib, 0), ("s/src/l.go", lib, 3)]
    d = spark.createDataFrame([(i, bytearray(c), t) for i, c, t in rows], "id string, content binary, t int").withColumn("ingested_at", P.F.timestamp_seconds("t"))
    got = {r.source_id: r.label for r in P.classify(d).collect()}
    assert got == {"author/src/l.go": "handwritten", "author/old/l.go": "handwritten", "q/third_party/l/l.go": "vendored", "s/src/l.go": "vendored"}


# ---------------------------------------------------------------- p5

GOOD = {
    "go": "package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K]) F(a ...int) (n int, err error) {\n\tfor i, v := range a {\n\t\tswitch x := v.(type) {\n\t\tcase int, *T[int]:\n\t\t\tn += i\n\t\tdefault:\n\t\t\tgo func() { <-c }()\n\t\t}\n\t}\n\tm := map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\tif v, ok := m[`x`]; ok && v[1:] != nil {\n\t\treturn len(v), nil\n\t} else if !ok {\n\t\tgoto end\n\t}\nend:\n\tselect {\n\tcase c <- 1:\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\treturn\n}\n",
    "rust": "#![allow(x)]\nuse a::{b, c::*};\n/* a /* nested */ comment */\n#[derive(Debug)]\npub struct P<'a, T: Clone + 'a> where T: Default { x: &'a T, y: [u8; 4] }\nimpl<'a, T> P<'a, T> {\n    pub const fn n(&self, f: impl Fn(u8) -> u8) -> Option<Vec<Vec<u8>>> {\n        let v: Vec<_> = self.it().map(|x| x >> 2).collect::<Vec<_>>();\n        match v.len() { 0 | 1 if true => None, n @ 2..=9 => Some(vec![]), _ => { return None; } }\n    }\n}\nmacro_rules! m { ($a:expr) => { $a + 1 }; }\nfn main() { let P { x, .. } = p else { return }; if let Some('\\'') = c { println!(\"{}\", r#\"a\"b\"#); } 'o: loop { break 'o; } }\n",
    "java": "package a.b;\nimport static c.D.*;\n@A(x = {1, 2})\npublic final class T<K extends Comparable<K>> implements I<Map<String, List<K>>> {\n  private static final int[] R = {1, 2,};\n  enum E { A(1) { void f() {} }, B; E() {} }\n  record P(int a, String... b) {}\n  <X> T(X x) throws E1, E2 { this(); }\n  int f(int a) {\n    for (var e : m.entrySet()) { q.forEach((x, y) -> x + y); s = (String) o; }\n    int r = switch (a) { case 1, 2 -> 3; default -> { yield 4; } };\n    try (var z = new Z<>() {}) { l: while (true) break l; } catch (A | B e) { throw e; } finally { }\n    return a > 3 ? b[1]++ : T::new == null ? -1 : x instanceof String s2 ? 1 : 2;\n  }\n}\n",
    "c": "#include <stdio.h>\n#ifdef A\n#define B(x) ((x) + 1)\n#else\nint z;\n#endif\ntypedef struct s { int a : 3; struct s *n; } S;\nstatic const unsigned char D[] = { [0] = 1, 2, };\nint (*fp)(int, void *);\nint f(const S *s, ...)\n{\n    for (int i = 0; i < 3; i++) { if (s->a) continue; else goto out; }\n    do { x = (int)y * sizeof(S) + sizeof x; } while (0);\n    switch (a) { case 'a': case B(2): break; default: ; }\nout:\n    return (S){ .a = 1 }.a ? \"a\" \"b\"[0] : 0;\n}\nint old(a, b) int a; char b; { return a; }\n",
    "javascript": "#!/usr/bin/env node\nimport d, { a as b } from 'x'\nexport default class extends Q { #p = 1; static async *g() { yield* f() } get x() { return this.#p } [k]() {} }\nconst { a, ...r } = o, re = /[/]\\/(/g, t = `a${b ? `c${d}` : {e: 1}.e}f`\nlet f = async (x, {y} = {}) => ({ x, y, [k]: 1, ...z })\nfor (const [k, v] of Object.entries(o)) if (v) continue; else break\nlabel: do { x ??= y?.z?.[1] ** 2 } while (x)\n!function(e){e.t=1}(this);\nvar i = 1 / 2 / 3\n",
    "typescript": "import type { A } from './a';\nenum E { A = 1, B }\nabstract class C<T extends object = {}> extends D<T> implements I {\n  private readonly x?: number = 1;\n  constructor(public a: string, b?: T[]) { super(); }\n  m<K extends keyof T>(k: K): T[K] | undefined { return (this.v as any)!.w<T>(k); }\n  abstract n(): void;\n}\ntype F = (a: number, ...b: string[]) => asserts a is string;\ntype M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\nfunction f(this: Window, x: unknown): x is string { return typeof x === 'string' && a < b && c > d; }\ndeclare module 'x' { export const y: number }\nlet g = <T,>(x: T) => x;\n",
    "python": "from __future__ import annotations\nimport a.b as c\n\n@d(1)\nasync def f(a, /, b: int = 1, *args, c, **kw) -> dict[str, int]:\n    async with x as (y, z), w:\n        pass\n    return [i async for i, *j in k if (n := i)] or {**a, 'b': lambda q=1: q}\n\nclass C(B, metaclass=M): x: int = 1; y = f'{a!r:>{w}}'\n\ntry:\n    pass\nexcept* E as e:\n    raise X from e\nelse: pass\nmatch p:\n    case {'a': [1, *_], **r} | Point(x=0) if r: ...\n    case _:\n        del a[1:2, ::3], b.c\nprint(*a, sep='')\nx = a if b else c\nmatch = 1\n",
    "bash": "#!/bin/bash\nset -euo pipefail\nf() {\n  local a=\"${1:-$(g \"x y\")}\" b=(1 2)\n  if [[ $a == x* && ! -f \"$b\" ]]; then return 1; elif ((a > 1)); then :; fi\n  case \"$1\" in (a|b) echo ')' ;; *) ;; esac\n  for ((i=0; i<3; i++)); do echo $((i + 1)); done\n  while read -r l; do x+=1; done < <(cat \"$f\") 2>&1 | sort &\n  cat <<-'E'\n\t<<<<<<< x\n\tE\n}\nfunction g { { a; } && ( b || c ); }\nselect x in 1 2; do break; done\necho a#b '#' \\\n  c # comment )\n",
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_texts_parse(language):
    assert G.parse(GOOD[language].encode(), language) == (True, "")
    assert G.parse(b"\xef\xbb\xbf" + GOOD[language].replace("\n", "\r\n").encode(), language)[0] or language == "bash"
    assert G.parse(b" \n\t", language)[0]


@pytest.mark.parametrize("language", GOOD)
def test_broken_texts_do_not(language):
    t = GOOD[language]
    for bad in (t + "\n<<<<<<< ours\n", t.replace("{", "", 1) if language != "python" else t.replace("(", "", 1), t[: len(t) // 2] + ")" + t[len(t) // 2 :], "<!DOCTYPE html>\n<html><body>x</body></html>\n", "@@ -1,3 +1,4 @@ f(\n-a\n+b\n" + t):
        assert not G.parse(bad.encode(), language)[0], bad[:60]


def test_python_agrees_with_the_language_itself():
    rng = random.Random(1)
    base = GOOD["python"].split("\n")
    agree = 0
    for _ in range(250):
        lines = list(base)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(lines))
            how = rng.randrange(4)
            lines[k : k + 1] = [[], [lines[k], lines[k]], [lines[k][: rng.randrange(len(lines[k]) + 1)]], [" " + lines[k]]][how]
        t = "\n".join(lines)
        try:
            compile(t, "x", "exec", ast.PyCF_ONLY_AST)
            ok = True
        except SyntaxError:
            ok = False
        agree += ok == G.parse(t.encode(), "python")[0]
    assert agree >= 245  # the language also refuses some trees, such as an assignment to a call


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("S = E ; E = E '+' E | E '*' E | N | '(' E ')' ;", ("S",))
    k = lambda t: [g.kinds[{"n": "N"}.get(c, c)] for c in t] + [0]
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("n+*()") for _ in range(rng.randrange(1, 9)))
        try:
            eval(t.replace("n", "1").replace("()", "(("), {})
            ok = "**" not in t and "++" not in t and "*+" not in t and "(+" not in t and t[0] != "+" and "1(" not in t and "n(" not in t and ")n" not in t and ")(" not in t and "nn" not in t
        except Exception:
            ok = False
        assert bool(g.accepts(k(t))[0]) == ok, t


def test_verdicts_and_rates(spark):
    f = files(spark, [("r/a.py", "python", b"x = 1\n"), ("r/a.py", "python", b"x = \n"), ("r/b.py", None, b""), ("r/c.go", "Go", b"package a\n"), ("r/d", "golang", b"package"), ("r/e.zig", "zig", b"?"), (None, "go", b""), ("r/f.go", "go", None), ("r/deep.js", "js", b"[" * 3000 + b"]" * 3000)])
    assert sorted(r.source_id for r in S.broken(f).collect()) == ["r/a.py", "r/d"]
    e = spark.createDataFrame([("r/a.py/ERROR_0", "syntax error", 1), ("r/c.go", "unsupported extension", 1), (None, "syntax error", 1)], "node_id string, message string, broken int")
    got = {(r.repository, r.language): (r.n_files, r.n_broken, r.n_broken_named) for r in S.rates(f, e).collect()}
    assert got == {("r", "python"): (2, 1, 1), ("r", "go"): (2, 1, 0), ("r", "javascript"): (1, 0, 0)}
    assert S.broken(f.limit(0)).count() == 0


# ---------------------------------------------------------------- p7


def test_encoding_equals_the_reference_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"
    ref = tiktoken.Encoding("own", pat_str=T.WORDS, mergeable_ranks=T.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    texts = ["", None, " ", "\n\n", "a" * 5000, "<|endoftext|> it's", "é́ 漢字 한글 🙂‍↔️", "x\r\ny\t z  ", "ab" * 700] + ["".join(rng.choice("aab é漢\n 1.,'s") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)] + [(0, "again", 2, "d")], "doc_id long, text string, ids int, k string")
    got = T.encode(df).collect()
    assert len(got) == len(texts) + 1
    for r in got[: len(texts)]:
        assert list(r.ids) == ref.encode_ordinary(texts[r.doc_id] or "")
    n = {r.doc_id: r.n_tokens for r in T.encode(df.filter("doc_id > 0"), ids=False).collect()}
    assert n[1] == 0 and n[4] == len(ref.encode_ordinary(texts[4]))
    assert T.encode(df.limit(0)).count() == 0


def test_both_merges_agree():
    ranks = T.read_ranks(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    for _ in range(200):
        w = bytes(rng.choice(b"abcde  the") for _ in range(rng.randrange(2, T.LONG_WORD)))
        assert T.merge_word(w, ranks) == T._merge_long(w, ranks)
    a = array("i")
    T.Encoder(ranks).encode("hello", a)
    assert len(a) == 1


# ---------------------------------------------------------------- p8


def test_sainte_lague_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(200):
        w = {f"s{i}": rng.choice([0, rng.random() * 10, float(rng.randrange(1, 5))]) for i in range(rng.randrange(1, 7))}
        most = {k: rng.randrange(0, 40) for k in w}
        seats = rng.randrange(0, 60)
        want = dict.fromkeys(w, 0)
        for _ in range(seats):
            live = [(-w[k] / (2 * want[k] + 1), k) for k in w if w[k] > 0 and want[k] < most[k]]
            if not live:
                break
            want[min(live)[1]] += 1
        assert M.sainte_lague(w, seats, most) == want


def test_mixture_shares_caps_and_dirt(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta token stream block share".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 60))), s, 9) for i, s in enumerate(["big"] * 900 + ["small"] * 40 + ["other"] * 200)]
    docs += [(5000, None, "big", 9), (5001, "", "big", 9), (5002, "words", None, 9), (5003, "words", "untargeted", 9), (0, docs[0][1], "big", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, repeats int")
    t = spark.createDataFrame([("big", 0.6, 2, 1), ("small", 0.1, 3, 1), ("other", 0.2, 1, 1), ("absent", 0.1, 5, 1), (None, 0.5, 1, 1)], "source string, target_share double, max_repeats int, tokens int")
    chosen, report = M.mix(d, t, shard_tokens=2000, block=64)
    rows = chosen.collect()
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 0.6 / 0.9) < 0.02 and abs(r["small"].actual_share - 0.1 / 0.9) < 0.02 and abs(r["other"].actual_share - 0.2 / 0.9) < 0.02 and r["absent"].actual_share == 0
    cap = {"big": 2, "small": 3, "other": 1}
    assert all(1 <= x.repeats <= cap[x.source] and x.n_tokens > 0 for x in rows)
    assert {(x.doc_id, x.repeats) for x in rows} == {(x.doc_id, x.repeats) for x in M.mix(d, t, shard_tokens=2000, block=64)[0].collect()}
    assert r["small"].tokens == sum(x.n_tokens * x.repeats for x in rows if x.source == "small")
    assert M.mix(d.limit(0), t)[0].count() == 0 and M.mix(d, t.limit(0))[0].count() == 0


# ---------------------------------------------------------------- p9


def test_disguises_come_off():
    words = lambda t: [X.word_of(x) for x in X._TOKEN.findall(X.plain(t))]
    for t in ("l o s e r", "l.o.s.e.r", "l0s3r", "lоsеr", "looooser", "l​o​s​e​r", "ＬＯＳＥＲ"):
        assert words(t) == ["loser"], t
    assert words("you l***r, go") == ["you", "<masked>", "go"]
    assert words("I saw a cat") == ["i", "saw", "a", "cat"]


def make(rng, n):
    benign = "the cache is stale;kill the child process;the parser crashed again;merge the branch first;shut down the server;this hack is ugly".split(";")
    bad = "you are a worthless idiot;shut up you idiot;i will hurt you tonight;people like you are vermin".split(";")
    out = []
    for i in range(n):
        lines = [rng.choice(benign) + f" {rng.randrange(99)}" for _ in range(rng.randrange(1, 8))]
        y = int(rng.random() < 0.3)
        if y:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(bad))
        out.append((i, "\n".join(lines), y, int(y ^ (rng.random() < 0.04))))
    return out


def test_classifier_on_held_out_documents(spark):
    rows = make(random.Random(8), 900)
    d = spark.createDataFrame([(i, t, "s", 0.5, True) for i, t, _, _ in rows] + [(9001, None, "s", 0.5, True), (9002, "", None, 0.5, True), (9003, "cache " * 50_000, "s", 0.5, True)], "doc_id long, text string, source string, score double, flagged boolean")
    lab = spark.createDataFrame([(i, "a", noisy, 1) for i, _, _, noisy in rows if i < 600] + [(None, "a", 1, 1), (3, "b", None, 1), (77777, "a", 1, 1)], "doc_id long, annotator string, toxic int, y int")
    m = X.fit(d, lab)
    got = {r.doc_id: r for r in X.score(d, m).collect()}
    truth = {i: y for i, _, y, _ in rows if i >= 600}
    hit = Counter((truth[i], got[i].flagged) for i in truth)
    assert hit[(1, True)] / (hit[(1, True)] + hit[(1, False)]) > 0.95 and hit[(0, True)] <= 3
    assert got[9001].score == 0 and got[9002].score == 0 and not got[9003].flagged and len(got) == len(rows) + 3
    r = {x.source: x for x in X.rates(X.score(d, m)).collect()}
    assert r[None].n_docs == 1 and r["s"].n_docs == len(rows) + 2
    assert X.score(d, X.fit(d, lab.limit(0))).filter("flagged").count() == 0 and X.score(d.limit(0), m).count() == 0
    q = X.held_out_quality(d, lab)
    assert q["documents"] > 30 and q["precision"] > 0.8 and q["recall"] > 0.8


def test_grams_stay_within_sentences():
    fx = X.Features()
    a = fx.sentences("one two. three four")
    flat = np.array(sum(a, []), dtype=np.uint64)
    sent = np.repeat(np.arange(2), [len(x) for x in a])
    f, o = fx.grams(flat, sent)
    assert len(f) == 6 and Counter(o.tolist()) == {0: 3, 1: 3}


def test_scored_as_in_training(spark):
    w, b = X.train([t for _, t, _, _ in make(random.Random(9), 200)], [float(y) for _, _, y, _ in make(random.Random(9), 200)])
    s = X.document_scores(["shut up you idiot", "the cache is stale", None, ""], w, b, X.Features())
    assert s[0] > 0.8 and s[1] < 0.2 and s[2] == s[3] == 0
