"""Documentation grammars: what they emit, and files that are long, cut off or nothing but openings."""

import time

import pytest

from lodestrata.llm import docpairs as D

SAYS = "Merges ranges that overlap."


@pytest.mark.parametrize(
    "language, text, functions",
    [
        ("go", f"// {SAYS}\nfunc (r *R[T]) Do(a int) {{}}\n\n// {SAYS}\ntype X struct{{}}\n\n// {SAYS}\nvar y = f(1)\n", 1),
        ("rust", f"/// {SAYS}\n#[inline]\npub(crate) async unsafe fn go() {{}}\n\n/// {SAYS}\nstruct S;\n\n/// {SAYS}\nimpl S {{}}\n", 1),
        ("js", f"/** {SAYS} */\nexport default async function* f<T>(a) {{}}\nclass A {{\n  /** {SAYS} */\n  static get [x](v) {{}}\n  /** {SAYS} */\n  field = 3;\n}}\n", 2),
        ("java", f"/** {SAYS} */\nclass A {{\n  /** {SAYS} */\n  @A(b = 1) public <T> Map<K, T[]> f(int a) {{ }}\n  /** {SAYS} */\n  int x = 3;\n}}\n", 1),
        ("c", f"/* {SAYS} */\nstatic const char *f(int a) {{ }}\n\n/* {SAYS} */\nint x = 3;\n\n/* {SAYS} */\ntypedef int (*g)(int);\n", 1),
        ("bash", f"# {SAYS}\nf() {{ :; }}\n\n# {SAYS}\nfunction g {{ :; }}\n\n# {SAYS}\nx=1\n", 2),
        ("python", f"# {SAYS}\n@d(1)\nasync def f(a): pass\n\n# {SAYS}\nx = 1\n", 1),
    ],
)
def test_only_functions_have_pairs(language, text, functions):
    got = D.documented_at(text.encode(), language)
    assert len(got) == functions
    for lo, at, doc, parts in got:
        assert doc <= lo <= at and SAYS.encode() in parts[0][1]


N = 200_000
LONG = {
    "unclosed comments": ("go", b"/* " * N, 0),
    "unclosed comments before a function": ("c", b"/* " * N + b"\n// " + SAYS.encode() + b"\nint f(int a) {}\n", 1),
    "one long line": ("js", b"a /* x */ + " * N + b"b;\n", 0),
    "raw strings": ("rust", b'r#" ' * N, 0),
    "escaped quotes": ("rust", b'\\" ' * N, 0),
    "quotes": ("bash", b'\\\\" ' + b'\\" ' * N, 0),
    "here-documents": ("bash", b"x=$((1 << A))\n<<B\n" * 50_000, 0),
    "comments above nothing": ("go", (b"// " + SAYS.encode() + b"\n") * 50_000 + b"\nvar x = 1\n", 0),
    "comments above nothing in python": ("python", (b"# " + SAYS.encode() + b"\n") * 50_000 + b"\nx = 1\n", 0),
    "functions without end": ("java", (b"/** " + SAYS.encode() + b" */\nint f(int a\n") * 20_000, 20_000),
    "a long word": ("java", b"/** " + SAYS.encode() + b" */\n" + b"a" * 1_000_000 + b"\n", 0),
    "blanks": ("c", b"// " + SAYS.encode() + b"\n" + b" " * 1_000_000 + b"int x;\n", 0),
}


@pytest.mark.parametrize("name", LONG)
def test_long_files(name):
    language, text, functions = LONG[name]
    began = time.perf_counter()
    assert len({lo for _, lo, *_ in D.documented(text, language)}) == functions
    assert time.perf_counter() - began < 10
