"""Functions paired with their documentation: packrat grammars per language, then an informativeness filter."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.peg import State, act, ahead, at_line_start, choice, closed, opt, rule, seq, star, term

#: node kinds of functions and methods
FUNCTION_KINDS = ("function_declaration", "method_declaration", "function_definition", "function_item", "method_definition")

# File extensions of the languages with a grammar.
LANGUAGES = {"go": "go", "rs": "rust", "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js", "java": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "sh": "bash", "bash": "bash"}
# Spellings of languages that files without such an extension may declare.
SPELLINGS = {"go": "go", "golang": "go", "rust": "rust", "rs": "rust", "python": "python", "py": "python", "python3": "python", "javascript": "js", "js": "js", "jsx": "js", "typescript": "js", "ts": "js", "tsx": "js", "java": "java", "c": "c", "c++": "c", "cpp": "c", "bash": "bash", "sh": "bash", "shell": "bash"}

# ---------------------------------------------------------------- grammars

_EOL = term(rb"[ \t]*\r?\n")
_BLANKS = term(rb"[ \t]*+")
_ANY = term(rb".")
_DQ = rb'"(?:[^"\\\n]|\\.)*+"'
_SQ = rb"'(?:[^'\\\n]|\\.)*+'"
_BALANCED = rb"\((?:[^()\"']++|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|\((?:[^()]++|\([^()]*+\))*+\))*+\)"


_BLOCK = closed(rb"/\*(?:[^*]|\*(?!/))*+\*/")


def _emit(what: str):
    return lambda s, i, j: s.out.append((what, i, j))


def _c_like(skip: bytes, function: bytes, attribute: bytes = rb"(?!)", exported: bytes = rb"", texts: tuple = ()):
    """Grammar of a language with // and /* */ comments. `skip` is text without any, `texts` are strings of many lines.

    File       <- (Skip / Text / Documented / Block / Comment / Any)*
    Documented <- (Block EOL Blanks / LineStart &Attribute) (Attribute EOL? Blanks)* Export? Function
    Block      <- LineStart Comment (EOL Blanks Comment)*          comments on adjoining lines
    Function   <- what begins a function or method: its words, its name and the bracket of its parameters
    """
    comment = rule(choice(term(rb"//[^\n\r]*+"), _BLOCK))
    block = rule(seq(at_line_start, comment, star(seq(_EOL, _BLANKS, comment))))
    attr = act(term(attribute), _emit("attr"))
    attributes = star(seq(attr, opt(_EOL), _BLANKS))
    doc = choice(seq(act(block, _emit("block")), _EOL, _BLANKS), seq(at_line_start, ahead(term(attribute))))
    documented = seq(doc, attributes, term(exported), act(term(function), _emit("function")))
    return star(choice(term(skip), *texts, documented, block, comment, _ANY))


_HERE = re.compile(rb"<<-?[ \t]*+(?P<q>[\"']?)(?P<w>\w+)(?P=q)[^\n]*+\n")


def _here(s: State, i: int) -> int:
    """A here-document up to the line that ends it."""
    m = _HERE.match(s.text, i)
    if m is None:
        return -1
    if s.lines is None:
        s.lines, at = {}, 0
        for x in s.text.split(b"\n"):
            s.lines.setdefault(x.strip(b" \t\r"), []).append(at)
            at += len(x) + 1
    where = s.lines.get(m["w"], ())
    k = bisect_left(where, m.end())
    return where[k] if k < len(where) else -1


def _hash_like(skip: bytes, function: bytes, texts: tuple):
    """Grammar of a shell: # comments that begin a word, quotes, here-documents."""
    comment = rule(term(rb"\#[^\n\r]*+"))
    block = rule(seq(at_line_start, comment, star(seq(_EOL, _BLANKS, comment))))
    documented = seq(act(block, _emit("block")), _EOL, _BLANKS, act(term(function), _emit("function")))
    return star(choice(term(skip), *texts, _here, documented, block, comment, _ANY))


def _python():
    """Grammar of Python: comment blocks and decorators above a def, and the string that begins its body.

    Def     <- Block? Decorator* ('async' Blanks)? 'def' Signature ':' Body
    Body    <- String / (Comment? EOL)+ Blanks String
    """
    string = rb"(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|" + _DQ + rb"|" + _SQ + rb")"
    comment = rule(term(rb"\#[^\n\r]*+"))
    block = rule(seq(at_line_start, comment, star(seq(_EOL, _BLANKS, comment))))
    head = act(block, _emit("block"))
    attr = act(term(rb"@[\w.]+[ \t]*(?:" + _BALANCED + rb")?[^\n]*+\n[ \t]*+"), _emit("attr"))
    start = act(term(rb"(?=(?:async[ \t]+)?def[ \t])"), _emit("function"))
    signature = term(rb"(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*+\])?[ \t]*" + _BALANCED + rb"[^:\n]*+(?:\[[^\]]*+\][^:\n]*+)?:[ \t]*+")
    doc = act(term(rb"[rRuU]?" + string), _emit("string"))
    body = choice(doc, seq(star(term(rb"[ \t]*+(?:\#[^\n]*+)?\r?\n"), 1), _BLANKS, doc))
    define = seq(opt(seq(head, _EOL, _BLANKS)), star(attr), start, opt(seq(signature, opt(body))))
    here = seq(at_line_start, ahead(term(rb"[\#@]|(?:async[ \t]+)?def[ \t]")), define)
    skip = term(rb"(?:[^\"'\#@da\\]++|[rRbBuUfF]{0,2}" + string + rb"|\\.|(?<=[^\n \t\xbf])[@da]|(?<=[ \t])(?<![\n ][ \t])(?<![\n \t][ \t])[@da]|d(?!ef[ \t])|a(?!sync[ \t]+def[ \t]))++")
    return star(choice(skip, here, block, comment, _ANY))


_TICKS = closed(rb"`[^`]*+`")
_TEMPLATE = closed(rb"`(?:[^`\\]|\\.)*+`")
_QUOTED = closed(rb"\"(?:[^\"\\]|\\.)*+\"")
_RAW = tuple(closed(rb"r\"[^\"]*+\"" if not n else rb"r\#{%d}\"(?:[^\"]|\"(?!\#{%d}))*+\"\#{%d}" % (n, n, n)) for n in range(4))
_GO = rb"(?:[^\"'`/]++|" + _DQ + rb"|'(?:[^'\\\n]|\\.)++'|/(?![/*]))++"
_RUST = rb"(?:[^\"'/r\#]++|r(?!\#*+\")|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|'(?=\w)|/(?![/*])|(?<=[^\n \t])\#|\#(?!!?\[))++"
_JS = rb"(?:[^\"'`/@]++|" + _DQ + rb"|" + _SQ + rb"|/(?![/*])|(?<=[^\n \t])@)++"
_JAVA = rb"(?:[^\"'/@]++|(?!\"\"\")" + _DQ + rb"|'(?:[^'\\\n]|\\.)++'|/(?![/*])|(?<=[^\n \t])@)++"
_C = rb"(?:[^\"'/]++|" + _DQ + rb"|'(?:[^'\\\n]|\\.)++'|/(?![/*]))++"
_SHELL = rb"(?:[^\"'\#\\<\n]++|\n|\\.|<(?!<)|(?<=[^\s;|&(])\#)++"
_ANNOTATION = rb"@(?!interface\b)[\w.]+[ \t]*(?:" + _BALANCED + rb")?"

# what begins a function or method in each language
_GO_FUNCTION = rb"func\b[ \t]*(?:\([^)]*+\)\s*)?\w+\s*[\[(]"
_RUST_FUNCTION = rb"(?:(?:pub(?:\s*\([^)]*+\))?|default|const|async|unsafe|extern(?:\s*\"[^\"\n]*+\")?)\s+)*+fn\s+(?:r\#)?\w+"
_JS_FUNCTION = rb"(?:(?:export|default|declare|static|async|get|set|public|private|protected|readonly|abstract|override|accessor|function)\b(?!\s*[(=:;?<])\s*|\*\s*)*+(?:function\b\s*\*?\s*)?(?:[\#\w$]++|\[[^\]\n]*+\]|" + _DQ + rb"|" + _SQ + rb")?\s*[?!]?\s*(?:<[^;{}]*?>\s*)?\("
_JAVA_FUNCTION = rb"(?!(?:return|throw|new|else)\b)(?:[\w.\[\]<>?,&$\s]++|@[\w.]++)++(?<=[\w$\s])\("
_C_FUNCTION = rb"(?!(?:return|typedef|else|goto)\b)[\w\s*&:<>,~=!+\-\[\]]++\("
_SHELL_FUNCTION = rb"(?:function[ \t]+[^\s(){}]+|[^\s(){}\#;&|]++[ \t]*\([ \t]*\))"

GRAMMARS = {
    "go": _c_like(_GO, _GO_FUNCTION, texts=(_TICKS,)),
    "rust": _c_like(_RUST, _RUST_FUNCTION, rb"\#!?\[(?:[^\[\]\"]++|\"(?:[^\"\\]|\\.)*+\"|\[[^\[\]]*+\])*+\]", texts=(_QUOTED, *_RAW)),
    "js": _c_like(_JS, _JS_FUNCTION, _ANNOTATION, rb"(?:export[ \t]+(?:default[ \t]+)?)?", texts=(_TEMPLATE,)),
    "java": _c_like(_JAVA, _JAVA_FUNCTION, _ANNOTATION, texts=(closed(rb"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\""), term(_DQ))),
    "c": _c_like(_C, _C_FUNCTION, rb"(?:__attribute__[ \t]*\(\([^)]*+\)\)|\[\[[^\]]*+\]\])"),
    "bash": _hash_like(_SHELL, _SHELL_FUNCTION, (_QUOTED, closed(rb"'[^']*+'"))),
    "python": _python(),
}

# ---------------------------------------------------------------- what a documentation says

# Words that describe nothing by themselves, and marks of directives and placeholders.
EMPTY_WORDS = frozenset(
    "a an the this that it its is are was be of for to in on and or with by from as at function functions method methods func fn def procedure routine helper "
    "subroutine constructor description descriptions desc summary doc docs document documentation documented comment comments missing add insert write me here see above below "
    "same ditto none na tbd todo fixme xxx hack wip placeholder stub auto autogenerated automatically generated begin end start section internal private public protected static "
    "inheritdoc deprecated override overrides args arguments arg param params parameter parameters return returns returned get gets set sets raises throws "
    "errors examples example note notes void int string bool nothing something class object type value does do performs perform implements implementation implementing "
    "needs need required pending later soon empty no not yet".split()
)
_DIRECTIVE = re.compile(
    r"^(?:copyright\b|licen[sc]ed under|section:|[-=*#~_]{3,}.*[-=*#~_]{3,}$|go:\w|nolint|lint:|line \S+:\d+|\+build|export \w+$|eslint|tslint|prettier-|istanbul|c8 ignore|v8 ignore|noqa|pylint|pyright|mypy:|flake8|type: *ignore|fmt: *(?:on|off|skip)|yapf|isort:|"
    r"pragma|shellcheck|clang-format|clang-tidy|cppcheck|nolintnextline|nosonar|nosec|checkstyle|@?ts-|@ts-|rustfmt|clippy|cov(?:erage)?:|lcov|gcov|swiftlint|spdx-|vim:|ex:|-\*-|#?region\b|#?endregion\b|"
    r"@formatter|cspell|spell-?checker|biome-|deno-|jshint|jslint|webpack|@flow|@jsx|@noinspection|noinspection|language=|sourcemappingurl|!/|@generated|@noflow|pyre-|ruff:|black:|bandit|skipcq|sonar|codeql|keep-sorted|gofmt|lint-|ignore-lint|\w+-(?:disable|enable|ignore)(?:-[\w-]+)?\b|\w+:(?:ignore|disable|skip|off|on)\b)",
    re.I,
)
_PENDING = re.compile(r"^(?:\W*)(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
_PLACEHOLDER = re.compile(r"^\W*(?:n/?a|see (?:above|below)|as above|ditto|tbd|docs? missing|no docs?(?:umentation)?|undocumented|(?:add|insert|write|put|missing|needs?) (?:a |the |some )?(?:docs?|documentation|description|comment)s?(?: here)?|lorem ipsum.*|auto-?generated (?:method|function|constructor) stub)\W*$", re.I)
_TAG = re.compile(r"^(?:\{@\w+[^}]*\}|[@\\]?(?:param|arg|argument|tparam|type|rtype|returns?|throws|exception|raises)\b:?|:(?:param|type|arg|raises|return|returns|rtype)\b[^:]*:|@\w+:?)", re.I)
_NAMED = re.compile(r"^(?:[@\\](?:param|arg|argument|tparam|throws|exception)|param)\b", re.I)
_CODE_END = re.compile(r"(?:[;{}]|\)\s*:|=>\s*\{?|\)\s*->\s*\S+|\belse:)\s*$")
_CODE = re.compile(
    r"^(?:(?:return|if|for|while|switch|match|else|elif|let|var|const|int|char|long|final|auto|fn|func|def|import|from|use|try|case|do|local|echo|with|raise|throw|await|print|del|assert)\b[^.]*[(){}\[\];=:+<>$]"
    r"|(?:[\w.\[\]*&$>-]|::)+\s*(?::=|\+=|-=|\*=|(?<![=!<>])=(?!=))\s*\S|[\w.:>-]+(?:::<[^>]*>)?\([^)]*\)[;,]?$|\w+\+\+|return(?:\s+\w+){0,2};?$|(?:fi|done|esac|then|break|continue|pass|else)$|[\w.]+\(.*\)\s*(?:;|\|\||&&)|\$\(|\[ .* \]|\[\[ )"
)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_ASCII = re.compile(r"[A-Za-z]+$")


def _lines(raw: bytes, mark: str) -> list[str]:
    """Lines of a comment block, string or doc attribute without their marks."""
    text = raw.decode("utf-8", "replace")
    if mark == "string":
        text = re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')(.*)\1$", r"\2", text, flags=re.S)
        return [x.strip() for x in text.splitlines()]
    if mark == "attr":
        return [x.strip() for m in re.finditer(r'^#\[\s*doc\s*=\s*r?#*"((?:[^"\\]|\\.)*)"#*\s*\]$', text, re.S) for x in m[1].replace("\\n", "\n").splitlines()]
    out = []
    for x in text.splitlines():
        x = x.strip()
        if x.startswith("#!"):
            continue
        x = re.sub(r"^(?:/\*+!?|//+!?|\#+(?!!)|\*(?!/))", "", x)
        out.append(re.sub(r"\*+/$", "", x).strip())
    return out


def _stem(w: str) -> str:
    """A word without its English ending, so that `Flushes`, `flushing` and `flush` meet."""
    for end, least in (("ing", 5), ("ies", 5), ("ied", 5), ("es", 4), ("ed", 4), ("er", 5), ("s", 3), ("e", 3), ("y", 3)):
        if w.endswith(end) and len(w) >= least + 1:
            return w[: -len(end)]
    return w


def _parts(identifiers: str) -> set[str]:
    return {_stem(_stem(x.lower())) for x in _SPLIT.findall(identifiers)}


@lru_cache(20_000)
def informative(lines: tuple[str, ...], signature: str) -> bool:
    """Whether documentation says more than the signature (its name first of all) does.

    Left out line by line: directives for tools, pending notes, placeholders, decoration, switched-off code, tags
    without text. Of the rest, a word counts unless it is empty by itself or repeats the signature in any inflection.
    """
    code = [bool(x) and bool(_CODE.match(x) or (_CODE_END.search(x) and not re.search(r"\w[.!?]\s", x))) for x in lines]
    known = None
    for x, is_code in zip(lines, code):
        if not x or is_code or _DIRECTIVE.match(x) or _PENDING.match(x) or _PLACEHOLDER.match(x):
            continue
        m = _TAG.match(x)
        if m:
            rest = x[m.end() :].strip()
            if _NAMED.match(x):
                rest = re.sub(r"^(?:\{[^}]*\}\s*)?[\[\w.\]$*]+\s*[-:]?\s*", "", rest)
            x = re.sub(r"^\{[^}]*\}", "", rest)
        for w in _WORD.findall(x):
            if not _ASCII.match(w):
                return True
            if known is None:
                known = _parts(signature)
            for p in _SPLIT.findall(w):
                p = p.lower()
                if len(p) > 1 and p not in EMPTY_WORDS and _stem(_stem(p)) not in known:
                    return True
    return False


_SKIPPED = rb"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)'"
_MARKS = re.compile(_SKIPPED + rb"|//[^\n]*|/\*.*?(?:\*/|\Z)|=>|[()\[\]{};\n]", re.S)
_MARKS_PYTHON = re.compile(rb"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|'(?:[^'\\\n]|\\.)*'|" + _SKIPPED + rb"|\#[^\n]*|[()\[\]{}:\n]", re.S)


def signature_end(content: bytes, at: int, language: str, stop: int | None = None) -> int:
    """Where the signature that begins at a byte ends: at the mark that opens the body, outside of brackets, strings and comments.

    stop: where the next documentation begins, behind which no signature goes on.

    Without such a mark it is the rest of the first line that ends outside of brackets, or of the first line.
    """
    depth, line, first = 0, -1, -1
    stop = len(content) if stop is None else stop
    for m in (_MARKS_PYTHON if language == "python" else _MARKS).finditer(content, at, stop):
        x = m[0]
        if depth <= 0 and (x == b":" if language == "python" else x in (b"{", b";", b"=>")):
            return m.start()
        if x in (b"(", b"[", b"{"):
            depth += 1
        elif x in (b")", b"]", b"}"):
            depth -= 1
        elif x == b"\n":
            first = m.start() if first < 0 else first
            line = m.start() if line < 0 and depth <= 0 else line
    return line if line >= 0 else first if first >= 0 else stop


def documented_at(content: bytes, language: str) -> list[tuple[int, int, int, list]]:
    """(first byte of attributes or function, first byte of the function, first byte of the documentation, its parts) of
    each function or method with documentation, as the grammar's actions emit them."""
    s = State(content)
    GRAMMARS[language](s, 0)
    out, held = [], []
    for what, i, j in s.out:
        if what == "string":
            out[-1][3].append(("string", content[i:j]))
        elif what != "function":
            held.append((what, i, j))
        else:
            lo = i
            for mark, x, y in held:
                if mark == "attr" or mark == "block":
                    lo = y if mark == "block" else x
                    break
            out.append((lo, i, held[0][1] if held else i, [(mark, content[x:y]) for mark, x, y in held]))
            held = []
    return [x for x in out if any(mark in ("block", "string") or b"doc" in raw for mark, raw in x[3])]


def documented(content: bytes, language: str):
    """(row, first byte, last byte, description) of each function or method whose documentation tells something.

    Its node begins on `row`, at a byte between the two (attributes may belong to it or not). Rows count from 0.
    """
    found, row, counted = [], 0, 0
    pairs = documented_at(content, language)
    for k, (lo, at, _, docs) in enumerate(pairs):
        stop = pairs[k + 1][2] if k + 1 < len(pairs) else len(content)
        row, counted = row + content.count(b"\n", counted, lo), lo
        lines = [x for mark, raw in docs for x in _lines(raw, mark)]
        head = content[at : signature_end(content, at, language, max(at, stop))].decode("utf-8", "replace")
        if informative(tuple(lines), head):
            text = "\n".join(x for x in lines).strip()
            first = row + (docs[0][0] == "block")
            last = row + content.count(b"\n", lo, at)
            found += [(r, lo, at, text) for r in range(first, last + 1)]
    return found


def documentation(files: DataFrame) -> DataFrame:
    """(source_id, row, lo, hi, description): the places below non-trivial documentation in each file.

    One narrow stage over the whole content; it is never shuffled. The grammar is that of the
    file's extension, else of the column `language`. Files without content, without id or of a language without grammar give no rows; repeated rows give repeated places. Bytes that are no UTF-8 are replaced in texts,
    offsets stay those of the source.
    """
    def named(col, names: dict[str, str]):
        return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[col]

    ext = F.lower(F.regexp_extract("id", r"\.([A-Za-z]+)$", 1))
    language = F.coalesce(named(ext, LANGUAGES), named(F.lower(F.trim("language")), SPELLINGS))
    src = files.select(F.col("id").alias("source_id"), language.alias("grammar"), "content").filter(F.col("content").isNotNull() & F.col("source_id").isNotNull() & F.col("grammar").isNotNull())

    def run(batches):
        for b in batches:
            rows = [(sid, *d) for sid, e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) for d in documented(c, e)]
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["source_id", "row", "lo", "hi", "description"])

    return src.mapInArrow(run, "source_id string, row long, lo long, hi long, description string")


def documented_functions(files: DataFrame, ast: DataFrame) -> DataFrame:
    """(node_id, source_id, start_byte, end_byte, description) of functions and methods with non-trivial documentation.

    Places from `documentation` meet syntax nodes on (source_id, row), so files with any number of functions spread over
    partitions; a node matches if it begins between the end of the documentation and the first token of the definition.
    Rows repeated in either table are folded; nodes without id, file or offsets match nothing.
    """
    nodes = ast.filter(F.col("node_kind").isin(*FUNCTION_KINDS) & F.col("node_id").isNotNull()).select("node_id", "source_id", F.col("start_row").alias("row"), "start_byte", "end_byte")
    places = documentation(files)
    hit = nodes.join(places, ["source_id", "row"]).filter((F.col("start_byte") >= F.col("lo")) & (F.col("start_byte") <= F.col("hi")))
    return hit.groupBy("node_id", "source_id", "start_byte", "end_byte").agg(F.max("description").alias("description"))


def pairs(files: DataFrame, ast: DataFrame, symbols: DataFrame) -> DataFrame:
    """Code-description pairs: node_id, source_id, language, signature (NULL where lsp_symbols has none), description, code.

    The code is cut from the content by byte offsets; of several rows of one file the smallest content by bytes that
    reaches the node's end holds, of several signatures the greatest.
    """
    hit = documented_functions(files, ast)
    detail = symbols.filter(F.col("node_id").isNotNull() & (F.trim("detail") != "")).groupBy("node_id").agg(F.max("detail").alias("signature"))
    text = files.filter(F.col("content").isNotNull()).select(F.col("id").alias("source_id"), F.lower(F.trim("language")).alias("language"), "content")
    cut = hit.join(text, "source_id").filter(F.octet_length("content") >= F.col("end_byte"))
    cut = cut.withColumn("code", F.expr("decode(substring(content, CAST(start_byte + 1 AS INT), CAST(end_byte - start_byte AS INT)), 'UTF-8')")).drop("content")
    one = cut.groupBy("node_id", "source_id", "description").agg(F.min(F.struct("code", "language")).alias("c"))
    return one.join(detail, "node_id", "left").select("node_id", "source_id", "c.language", "signature", "description", "c.code")
