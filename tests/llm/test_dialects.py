"""Verdicts on dialects, and on texts that are long or deeply nested."""

import time

import pytest

from lodestrata.llm.grammars import C, CPP, EXTENSIONS, PARSERS, SHELL, lex_shell, parse, shell_dialects

CPP_TEXT = """#pragma once
#include <vector>
namespace a::b { inline namespace v1 {
template <typename T, int N = 3, template <class> class C = std::vector>
class [[nodiscard]] Box final : public Base<T>, private virtual Other {
 public:
  explicit Box(int n) noexcept : n_{n}, m_(n > 3 ? n : 2) {}
  Box(const Box&) = default;
  Box& operator=(Box&& o) = delete;
  virtual ~Box();
  friend bool operator<(const Box& l, const Box& r) { return l.n_ < r.n_; }
  template <class U> auto get(U&& u) const & -> decltype(u.x()) { return std::forward<U>(u).template f<int>(); }
  operator bool() const { return n_ != 0; }
  T operator()(int i) const override;
  static constexpr int kN = 1'000;
  enum class E : unsigned { A = 1 << 2, B };
 private:
  int n_ = 0, *p_{nullptr};
  std::map<std::string, std::vector<std::pair<int, T>>> m_;
};
}}
using F = int (*)(const char*, ...);
typedef struct S { int a : 3; } S;
template <typename... Ts> void f(Ts&&... ts) { (g(std::forward<Ts>(ts)), ...); }
template <typename T> concept Num = requires(T t) { { t + t } -> std::same_as<T>; typename T::x; };
template <Num T> requires (sizeof(T) > 2) T h(T x) { return x; }
int Box<int>::f(int (&a)[3]) try {
  for (auto& [k, v] : m) if (auto it = q.find(k); it != q.end()) continue; else break;
  auto l = [&, this, x = std::move(y)](auto&& a) mutable -> int { return a ? *a : 0; };
  switch (x) { case E::A: { break; } default: throw std::runtime_error(R"x(a")x"); }
  std::unique_ptr<int[]> p(new int[3]{1, 2, 3}); delete[] q;
  if constexpr (std::is_same_v<T, int>) return static_cast<int>(x) + sizeof...(Ts); else { co_return; }
  for (int i = 0; i < 3; ++i) a.b->c[i] = {1, 2};
  while (x >> 1) do { --x; } while (x <=> y);
  T t{}; int* const r = &x; Foo foo(1, 2); const auto s = "a"_s "b";
  return {1, 2};
} catch (const std::exception& e) { } catch (...) { }
"""


def test_c_plus_plus():
    assert parse(CPP_TEXT.encode(), "cpp") == (True, "")
    for bad in (CPP_TEXT.replace("}", "", 1), CPP_TEXT[:900], CPP_TEXT + "\n<<<<<<< a\n", "class A { int x }\n", "int f( { }\n", "def f(x):\n    return x\n"):
        assert not parse(bad.encode(), "cpp")[0], bad[:40]
    assert parse(CPP_TEXT.encode(), "header")[0] and not parse(CPP_TEXT.encode(), "c")[0]
    assert all(EXTENSIONS[e] == "cpp" for e in ("cc", "cpp", "hpp")) and EXTENSIONS["h"] == "header"


@pytest.mark.parametrize(
    "text",
    ["[[nodiscard]] int f(void);\n", "constexpr int n = 1;\nenum e : unsigned char { A };\n", "int f(int) { x: int y = 1; return (typeof(y)){ 3 }; }\n", "_BitInt(3) x;\nauto y = nullptr;\nstatic_assert(1);\n", "int old(a, b) int a; char b; { return a; }\n"],
)
def test_c_of_several_years(text):
    assert parse(text.encode(), "c")[0]


@pytest.mark.parametrize(
    "language, text, valid",
    [
        ("javascript", "const a = <div className=\"x\" {...p} data-k={1}>text {f(<b/>)} it's <i.x>y</i.x></div>;\n", True),
        ("javascript", "function f() { return (\n <>\n  {/* note */}\n  {xs.map(x => <li key={x}>{x}</li>)}\n </>\n); }\n", True),
        ("javascript", "const a = <div><span></div>;\n", False),
        ("javascript", "const a = <div>;\n", False),
        ("javascript", "if (a < b && c > d) { x = a </b/.exec(c) }\n", True),
        ("javascript", "<!DOCTYPE html>\n<html><body>x</body></html>\n", False),
        ("tsx", "const f = <T,>(x: T) => <Box<T> />;\n", False),
        ("tsx", "const f = <T,>(x: T): JSX.Element => <p>{x as any}</p>;\n", True),
        ("typescript", "const f = <T>x;\n", True),
        ("typescript", "const f = <p>{x}</p>;\n", False),
        ("rust", "fn main() { let async = 1; }\n", True),
        ("rust", "trait T { fn f(u8, &str); }\n", True),
        ("rust", "fn f(u8 { }\n", False),
        ("java", "class A { void f() { int enum = 1; assert = 2; } }\n", True),
        ("python", "async = 1\nawait = async\n", True),
        ("python", "async def f():\n    await x\n", True),
        ("bash", "function() { :; }\nselect() { echo; }\n", True),
        ("bash", "a=(1 2)\n[[ -n $a ]] && cat <<< x |& tee >(wc)\n", True),
        ("bash", "function() { a=(1 2); }\n", False),
        ("bash", "x=$( (echo a); echo b)\ny=$(((1+2)*3))\n((a)); ((echo b); echo c)\n", True),
        ("bash", "x=$(case $y in a) echo b;; *) c ;; esac)\n", True),
        ("bash", "x=$(cat <<E\n)\nE\n)\necho \"$(echo \"${y:-\"$(z)\"}\")\" `echo \\`a\\``\n", True),
        ("bash", "echo $(if)\n", False),
        ("bash", "echo \"$(f\"\n", False),
        ("bash", "echo case in x\n( echo esac )\n", True),
    ],
)
def test_dialects(language, text, valid):
    assert parse(text.encode(), language)[0] is valid


def test_shell_dialects_differ():
    of = lambda t: shell_dialects(lex_shell(t))[0]
    assert of("function() { :; }\n") == {"Posix"} and of("a=(1)\n") == {"Bash"} and of("echo a | b\n") == {"Bash", "Posix"}
    assert of("echo $(a=(1))\n") == {"Bash"} and not of("function() { :; }; echo $(a=(1))\n")


DEEP = 100_000
LONG = {
    "brackets": ("javascript", "x = " + "[" * DEEP + "]" * DEEP + ";\n", True),
    "unclosed brackets": ("javascript", "x = " + "[" * DEEP + "]" * (DEEP - 1) + ";\n", False),
    "round brackets": ("python", "x = " + "(" * DEEP + "1" + ")" * DEEP + "\n", True),
    "blocks": ("c", "int f(void) " + "{" * DEEP + "}" * DEEP + "\n", True),
    "elements": ("javascript", "x = " + "<a>" * 20_000 + "</a>" * 20_000 + ";\n", True),
    "sum": ("javascript", "x = " + "a + " * DEEP + "b;\n", True),
    "sum in go": ("go", "package a\n\nvar x = " + "a + " * DEEP + "b\n", True),
    "sum in rust": ("rust", "const X: u8 = " + "a + " * DEEP + "b;\n", True),
    "broken sum": ("c", "int x = " + "a + " * DEEP + ";\n", False),
    "substitutions": ("bash", "echo " + "$(echo " * 10_000 + ")" * 10_000 + "\n", True),
    "quoted substitutions": ("bash", "echo " + '"$(echo ' * 10_000 + ')"' * 10_000 + "\n", True),
    "unclosed substitutions": ("bash", "echo " + "$(echo " * 10_000 + "\n", False),
    "arithmetic": ("bash", "echo " + "$((1 + " * 10_000 + "2" + "))" * 10_000 + "\n", True),
    "no arithmetic": ("bash", "echo " + "$((a) ; " * 3_000 + ")" * 3_000 + "\n", True),
    "never arithmetic": ("bash", "echo " + "$((" * 20_000 + "\n", False),
    "shifts": ("bash", "x=$((1<<A))\n" * 20_000, True),
    "cases": ("bash", "case x in a) " * 5_000 + ":" + " ;; esac" * 5_000 + "\n", True),
    "unclosed comment": ("c", "/* " * 300_000, False),
    "unclosed comment in rust": ("rust", "/* " * 300_000, False),
    "raw strings": ("rust", 'r#" ' * 200_000, False),
}


@pytest.mark.parametrize("name", LONG)
def test_long_and_deep_texts(name):
    language, text, valid = LONG[name]
    began = time.perf_counter()
    assert parse(text.encode(), language)[0] is valid
    assert time.perf_counter() - began < 15  # far from what anything but linear time would take


def test_every_grammar_is_compiled_once():
    assert {g for groups in PARSERS.values() for _, g in groups} >= {C, CPP, SHELL}
