"""Lexers and grammars of nine languages and their dialects for the generalised LL parser. A lexer returns (kinds,
positions with a line break before them), and raises ValueError where the text can't be cut into tokens at all."""

from __future__ import annotations

import re
from bisect import bisect_left

from lodestrata.llm.gll import Grammar

# ---------------------------------------------------------------- shared pieces of C-like languages

_ID = r"[^\W\d]\w*"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eEpP][+-]?[\d_]+)?)\w*"
_DQ = r'"(?:[^"\\\n]|\\(?:.|\n))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"


class _Known(dict):
    """Token text -> kind, -1 for blanks and comments, -2 for a line break; what a text is depends on itself alone."""

    def __init__(self, pattern: re.Pattern, words: dict[str, int], kinds: dict[str, int], classes: dict[str, int]):
        self.full, self.words, self.kinds, self.classes = pattern.fullmatch, words, kinds, classes

    def __missing__(self, text: str) -> int:
        g = self.full(text).lastgroup
        if g is None or g in ("bad", "torn", "worse"):
            raise ValueError(repr(text[:20]))
        if g == "w":
            k = -1
        elif g == "n":
            k = -2
        elif g == "i":
            k = self.words.get(text, self.classes["i"])
        elif g == "o":
            k = self.kinds.get(text)
            if k is None:
                raise ValueError(repr(text[:20]))
        else:
            k = self.classes[g]
        if len(text) <= 24:
            if len(self) >= KNOWN_TOKENS:
                self.clear()
            self[text] = k
        return k


KNOWN_TOKENS = 200_000


class Lexer:
    """A token pattern with the groups w (blanks), n (line breaks), i (words), o (operators) and one per token class."""

    def __init__(self, pattern: str, keywords: str, grammar: Grammar, classes: dict[str, str]):
        # what can't be cut is taken to the end of the text at once, so that nothing is tried again behind it
        self.pattern = re.compile(pattern.replace(r"|(?P<n>\n)", r"|(?P<bad>/\*.*)|(?P<n>\n)", 1) + "|(?P<worse>.+)", re.S)
        self.kinds = grammar.kinds
        self.words = {w: self.kinds[w] for w in keywords.split() if w in self.kinds}
        self.known = _Known(self.pattern, self.words, self.kinds, {"i": self.kinds["ID"]} | {g: self.kinds[k] for g, k in classes.items() if k in self.kinds})

    def texts(self, text: str) -> list[str]:
        """The text cut into tokens; raises ValueError at a character that begins none."""
        return [m[0] for m in self.pattern.finditer(text)]

    def plain(self, text: str) -> list[int]:
        """Kinds of the tokens of a language in which line breaks mean nothing."""
        known = self.known
        return [k for k in [known[t] for t in self.texts(text)] if k >= 0] + [0]

    def tokens(self, text: str):
        """(kinds, positions of those that are first on a line)."""
        known, out, breaks, fresh = self.known, [], set(), False
        for k in [known[t] for t in self.texts(text)]:
            if k >= 0:
                if fresh:
                    breaks.add(len(out))
                    fresh = False
                out.append(k)
            elif k == -2:
                fresh = True
        out.append(0)
        return out, breaks


# ---------------------------------------------------------------- Go

GO = Grammar(
    """
    File = 'package' ID Semi Import* Top* ;
    Semi = ';' ;
    Import = 'import' ( Spec | '(' ( Spec ( Semi Spec )* Semi? )? ')' ) Semi ;
    Spec = ( ID | '.' )? STR ;
    Top = Decl Last | Func Last ;
    Last = ';' | @newline ;
    Decl = 'const' ( ConstSpec | '(' ( ConstSpec ( Semi ConstSpec )* Semi? )? ')' ) | 'var' ( VarSpec | '(' ( VarSpec ( Semi VarSpec )* Semi? )? ')' ) | 'type' ( TypeSpec | '(' ( TypeSpec ( Semi TypeSpec )* Semi? )? ')' ) ;
    ConstSpec = Ids ( Type? '=' Exprs )? ;
    VarSpec = Ids ( Type ( '=' Exprs )? | '=' Exprs ) ;
    TypeSpec = ID TypeParams? '='? Type ;
    TypeParams = '[' TypeParam ( ',' TypeParam )* ','? ']' ;
    TypeParam = Ids Union ;
    Union = '~'? Type ( '|' '~'? Type )* ;
    Ids = ID ( ',' ID )* ;
    Func = 'func' Params? ID TypeParams? Params Result? Block? ;
    Params = '(' ( Param ( ',' Param )* ','? )? ')' ;
    Param = ID? '...'? Type ;
    Result = Type | Params ;
    Type = Name TypeArgs? | '*' Type | '[' ( Expr | '...' )? ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Params Result? | Struct | Interface | '(' Type ')' ;
    Name = ID ( '.' ID )? ;
    TypeArgs = '[' Type ( ',' Type )* ','? ']' ;
    Struct = 'struct' '{' ( Field ( Semi Field )* Semi? )? '}' ;
    Field = ( Ids Type | '*'? Name TypeArgs? ) STR? ;
    Interface = 'interface' '{' ( Method ( Semi Method )* Semi? )? '}' ;
    Method = ID Params Result? | Union ;
    Block = '{' Stmts '}' ;
    Stmts = ( Stmt ( Semi Stmt )* )? ;
    Stmt = Decl | Simple? | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | Block | If | Switch | Select | For | ID ':' Stmt ;
    Simple = Exprs ( '++' | '--' | AssignOp Exprs | ':=' Exprs | '<-' Expr )? ;
    AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
    If = 'if' ( Simple? Semi )? Expr Block ( 'else' ( If | Block ) )? ;
    Switch = 'switch' ( Simple? Semi )? ( Expr | ID ':=' Primary '.' '(' 'type' ')' | Primary '.' '(' 'type' ')' )? '{' Case* '}' ;
    Case = ( 'case' CaseItem ( ',' CaseItem )* | 'default' ) ':' Stmts ;
    CaseItem = Expr | Type ;
    Select = 'select' '{' ( ( 'case' Simple | 'default' ) ':' Stmts )* '}' ;
    For = 'for' ( Expr | Simple? Semi Expr? Semi Simple? | ( Exprs ( ':=' | '=' ) )? 'range' Expr )? Block ;
    Exprs = Expr ( ',' Expr )* ;
    Expr = Unary ( BinOp Unary )* ;
    BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
    Unary = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' )* Primary ;
    Primary = Operand Suffix* ;
    Operand = NUM | STR | CHAR | ID | '(' Expr ')' | 'func' Params Result? Block | LitType Lit | Conv ;
    LitType = '[' ( Expr | '...' )? ']' Type | 'map' '[' Type ']' Type | Struct ;
    Conv = ( '[' Expr? ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Params Result? | Interface | '(' Type ')' ) '(' Args ')' ;
    Suffix = '.' ID | '.' '(' Type ')' | '[' Exprs ']' | '[' TypeArg ( ',' TypeArg )* ']' | '[' Expr? ':' Expr? ( ':' Expr )? ']' | '(' Args ')' | Lit ;
    TypeArg = '*' Type | '[' ( Expr | '...' )? ']' Type | 'map' '[' Type ']' Type | 'func' Params Result? | Struct | Interface ;
    Args = ( Arg ( ',' Arg )* '...'? ','? )? ;
    Arg = Expr | 'chan' Type | 'map' '[' Type ']' Type | '[' Expr? ']' Type | '*' Type | Struct | Interface | 'func' Params Result? ;
    Lit = '{' ( Elem ( ',' Elem )* ','? )? '}' ;
    Elem = Value ( ':' Value )? ;
    Value = Expr | Lit ;
    """,
    ("File",),
)
_GO_KEYS = "package import const var type func map chan struct interface go defer return break continue goto fallthrough if else switch case default select for range"
_GO_LEX = Lexer(
    rf"(?P<w>[ \t\r]+|//[^\n]*|{_BLOCK})|(?P<n>\n)|(?P<i>{_ID})|(?P<num>{_NUM})|(?P<str>{_DQ}|`[^`]*`)|(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}))')"
    r"|(?P<o>\.\.\.|&\^=?|<<=?|>>=?|<-|\+\+|--|&&|\|\||:=|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>(){}\[\],;.:~])",
    _GO_KEYS, GO, {"num": "NUM", "str": "STR", "chr": "CHAR"},
)
_GO_ENDS = {GO.kinds[x] for x in ("ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}


def lex_go(text: str):
    """Go puts a semicolon where a line ends after a token that can end a statement; one before ) or } may be left out."""
    toks, breaks = _GO_LEX.tokens(text)
    semi, close = GO.kinds[";"], (GO.kinds[")"], GO.kinds["}"])
    out, new = [], set()
    for i, k in enumerate(toks):
        if (i in breaks or k == 0) and out and out[-1] in _GO_ENDS:
            out.append(semi)
        if k in close and out and out[-1] == semi and i in breaks:
            # `Stmts` and lists allow the closing bracket right after their last entry
            out.pop()
        out.append(k)
    return out, new


# ---------------------------------------------------------------- Rust

_RUST_RULES = """
    File = InnerAttr* Item* ;
    InnerAttr = '#' '!' '[' Trees ']' ;
    Attr = '#' '[' Trees ']' ;
    Trees = Tree* ;
    Tree = '(' Trees ')' | '[' Trees ']' | '{' Trees '}' | Any ;
    Any = ID | NUM | STR | CHAR | LIFE | AnyKey | AnyOp ;
    AnyKey = 'as' | 'async' | 'await' | 'break' | 'const' | 'continue' | 'crate' | 'dyn' | 'else' | 'enum' | 'extern' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'self' | 'Self' | 'static' | 'struct' | 'super' | 'trait' | 'type' | 'unsafe' | 'use' | 'where' | 'while' | 'union' | 'macro_rules' | 'default' | '_' ;
    AnyOp = '::' | '->' | '=>' | '..' | '...' | '..=' | '==' | '!=' | '<=' | '>=' | '&&' | '||' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '+' | '-' | '*' | '/' | '%' | '^' | '!' | '&' | '|' | '=' | '<' | '>' | '@' | '.' | ',' | ';' | ':' | '#' | '$' | '?' | '~' ;
    Item = Attr* Vis? Kind | Attr* MacroItem ;
    Vis = 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' Path ) ')' )? ;
    Kind = Use | Fn | StructItem | Enum | Impl | Trait | Mod | Const | TypeItem | ExternBlock | UnionItem ;
    MacroItem = Path '!' Name? ( '(' Trees ')' ';' | '[' Trees ']' ';' | '{' Trees '}' ) | 'macro_rules' '!' ID ( '(' Trees ')' ';' | '[' Trees ']' ';' | '{' Trees '}' ) ;
    Use = 'use' UseTree ';' | 'extern' 'crate' ( ID | 'self' ) ( 'as' ( ID | '_' ) )? ';' ;
    UseTree = '::'? '{' ( UseTree ( ',' UseTree )* ','? )? '}' | '::'? '*' | '::'? Seg ( '::' Seg )* ( '::' ( '*' | '{' ( UseTree ( ',' UseTree )* ','? )? '}' ) | 'as' ( ID | '_' ) )? ;
    Seg = Name | 'crate' | 'self' | 'super' | 'Self' ;
    Name = ID | 'union' | 'default' | 'macro_rules' ;
    Path = '::'? Seg ( '::' Seg )* ;
    Fn = ( 'const' | 'async' | 'unsafe' | 'default' | 'extern' STR? )* 'fn' Name Generics? '(' FnParams ')' ( '->' Type )? Where? ( Block | ';' ) ;
    FnParams = ( FnParam ( ',' FnParam )* ','? )? ;
    FnParam = Attr* ( SelfParam | Pattern ':' Type | Pattern ':' '...' | '...' ) ;
    SelfParam = ( '&' LIFE? )? 'mut'? 'self' ( ':' Type )? ;
    Generics = '<' ( GenParam ( ',' GenParam )* ','? )? '>' ;
    GenParam = Attr* ( LIFE ( ':' LifeBounds )? | Name ( ':' Bounds? )? ( '=' Type )? | 'const' ID ':' Type ( '=' ( Block | Literal ) )? ) ;
    LifeBounds = ( LIFE ( '+' LIFE )* )? ;
    Bounds = Bound ( '+' Bound )* '+'? ;
    Bound = LIFE | '?'? ForLife? TypePath | '(' '?'? ForLife? TypePath ')' ;
    ForLife = 'for' Generics ;
    Where = 'where' ( WherePred ( ',' WherePred )* ','? )? ;
    WherePred = LIFE ':' LifeBounds | ForLife? Type ':' Bounds? ;
    StructItem = 'struct' Name Generics? ( ';' | Where? '{' Fields '}' | '(' TupleFields ')' Where? ';' | Where ';' ) ;
    UnionItem = 'union' Name Generics? Where? '{' Fields '}' ;
    Fields = ( Field ( ',' Field )* ','? )? ;
    Field = Attr* Vis? Name ':' Type ;
    TupleFields = ( TupleField ( ',' TupleField )* ','? )? ;
    TupleField = Attr* Vis? Type ;
    Enum = 'enum' Name Generics? Where? '{' ( Variant ( ',' Variant )* ','? )? '}' ;
    Variant = Attr* Vis? Name ( '{' Fields '}' | '(' TupleFields ')' )? ( '=' Expr )? ;
    Impl = 'default'? 'unsafe'? 'impl' Generics? '!'? Type ( 'for' Type )? Where? '{' InnerAttr* Assoc* '}' ;
    Assoc = Attr* Vis? ( Fn | Const | TypeItem ) | Attr* MacroItem ;
    Trait = 'unsafe'? 'trait' Name Generics? ( ':' Bounds? )? Where? '{' InnerAttr* Assoc* '}' ;
    Mod = 'unsafe'? 'mod' Name ( ';' | '{' InnerAttr* Item* '}' ) ;
    Const = 'const' ( Name | '_' ) ( ':' Type )? ( '=' Expr )? ';' | 'static' 'mut'? Name ':' Type ( '=' Expr )? ';' ;
    TypeItem = 'type' Name Generics? ( ':' Bounds? )? Where? ( '=' Type )? Where? ';' ;
    ExternBlock = 'unsafe'? 'extern' STR? '{' InnerAttr* Assoc* '}' ;
    Type = TypePath | '&' LIFE? 'mut'? Type | '&&' LIFE? 'mut'? Type | '*' ( 'const' | 'mut' ) Type | '[' Type ( ';' Expr )? ']' | '(' ( Type ( ',' Type )* ','? )? ')' | '!' | '_' | 'impl' Bounds | 'dyn' Bounds | ForLife? FnType | ForLife TypePath | TypePath '!' ( '(' Trees ')' | '[' Trees ']' | '{' Trees '}' ) ;
    FnType = 'unsafe'? ( 'extern' STR? )? 'fn' '(' ( FnTypeParam ( ',' FnTypeParam )* ','? )? ')' ( '->' Type )? ;
    FnTypeParam = ( ( Name | '_' ) ':' )? Type | '...' ;
    TypePath = '::'? TypeSeg ( '::' TypeSeg )* | '<' Type ( 'as' TypePath )? '>' ( '::' TypeSeg )+ ;
    TypeSeg = Seg ( '::'? Angle | '(' ( Type ( ',' Type )* ','? )? ')' ( '->' Type )? )? ;
    Angle = '<' ( GenArg ( ',' GenArg )* ','? )? '>' ;
    GenArg = LIFE | Type | Literal | '-' Literal | Block | Name Angle? '=' Type | Name Angle? ':' Bounds ;
    Block = '{' InnerAttr* Stmt* Last? '}' ;
    Stmt = ';' | Item | Attr* Let | Attr* BlockLike | Attr* Expr ';' | Path '!' '{' Trees '}' ;
    Last = Attr* Expr ;
    Let = 'let' Pattern ( ':' Type )? ( '=' Expr ( 'else' Block )? )? ';' ;
    BlockLike = Label? ( Block | 'loop' Block | 'while' Expr Block | 'for' Pattern 'in' Expr Block ) | 'unsafe' Block | 'async' 'move'? Block | 'const' Block | If | Match ;
    Label = LIFE ':' ;
    If = 'if' Expr Block ( 'else' ( If | Block ) )? ;
    Match = 'match' Expr '{' InnerAttr* ( Arm+ LastArm? | LastArm )? '}' ;
    Arm = Attr* Pattern ( 'if' Expr )? '=>' ( Expr ',' | BlockLike ','? ) ;
    LastArm = Attr* Pattern ( 'if' Expr )? '=>' Expr ;
    Expr = Unary ( BinOp Unary | 'as' Type | RangeOp Unary? )* | RangeOp ( Unary ( BinOp Unary | 'as' Type )* )? ;
    RangeOp = '..' | '..=' | '...' ;
    BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<' '<' | '>' '>' | '&' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=' ;
    Unary = ( '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ( 'const' | 'mut' ) )* Postfix ;
    Postfix = Primary Suffix* ;
    Suffix = '?' | '.' ( 'await' | Name ( '::' Angle )? | NUM ) | '(' Args ')' | '[' Expr ']' ;
    Args = ( Attr* Expr ( ',' Attr* Expr )* ','? )? ;
    Primary = Literal | PathExpr | PathExpr StructLit | '(' Args ')' | '[' ( Expr ( ';' Expr | ( ',' Expr )* ','? ) )? ']' | Closure | BlockLike | 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | Path '!' ( '(' Trees ')' | '[' Trees ']' | '{' Trees '}' ) | 'let' Pattern '=' Unary ;
    Literal = NUM | STR | CHAR ;
    PathExpr = '::'? ESeg ( '::' ESeg )* | '<' Type ( 'as' TypePath )? '>' ( '::' ESeg )+ ;
    ESeg = Seg ( '::' Angle )? ;
    StructLit = '{' ( FieldInit ( ',' FieldInit )* ( ',' '..' Expr? )? ','? | '..' Expr )? '}' ;
    FieldInit = Attr* ( Name | NUM ) ( ':' Expr )? ;
    Closure = 'static'? 'async'? 'move'? ( '||' | '|' ( ClParam ( ',' ClParam )* ','? )? '|' ) ( '->' Type Block | Expr ) ;
    ClParam = Attr* PatNoAlt ( ':' Type )? ;
    Pattern = '|'? PatNoAlt ( '|' PatNoAlt )* ;
    PatNoAlt = '-'? Literal ( RangeOp ( '-'? Literal | PathExpr )? )? | RangeOp '-'? Literal | '..' | '_' | 'ref'? 'mut'? Name ( '@' PatNoAlt )? | '&' 'mut'? PatNoAlt | '&&' 'mut'? PatNoAlt | '(' Pats ')' | '[' Pats ']' | PathExpr ( RangeOp ( '-'? Literal | PathExpr )? )? | PathExpr '(' Pats ')' | PathExpr '{' ( FieldPat ( ',' FieldPat )* ','? )? '}' | Path '!' '(' Trees ')' | 'box' PatNoAlt ;
    Pats = ( Pattern ( ',' Pattern )* ','? )? ;
    FieldPat = Attr* ( ( Name | NUM ) ':' Pattern | 'ref'? 'mut'? Name | '..' ) ;
    """
RUST = Grammar(_RUST_RULES, ("File",))
_RUST_LEX = Lexer(
    rf"(?P<w>[ \t\r]+|//[^\n]*)|(?P<n>\n)|(?P<str>b?r(?P<h>\#*)\".*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*\")|(?P<torn>b?r\#*\".*|[bc]?\".*)|(?P<chr>b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}))')|(?P<life>'{_ID})|(?P<i>(?:r\#)?{_ID})"
    r"|(?P<num>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)\w*)"
    r"|(?P<o>\.\.\.|\.\.=|<<=|::|->|=>|\.\.|&&|\|\||[-+*/%^&|=!<>]=|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]])",
    "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while union macro_rules default _ box raw",
    RUST, {"num": "NUM", "str": "STR", "chr": "CHAR", "life": "LIFE"},
)
_RUST_SOFT = {RUST.kinds[k]: RUST.kinds["ID"] for k in ("box", "raw")}


def lex_rust(text: str):
    """Block comments nest; `box` and `raw` are words unless the grammar's rule for them could follow."""
    text = re.sub(r"\A#![^\[\n][^\n]*", "", text)
    if "/*" in text:
        text = _nested_comments(text)
    toks = _RUST_LEX.plain(text)
    amp = RUST.kinds["&"]
    for i, k in enumerate(toks):
        if k in _RUST_SOFT and not (i and toks[i - 1] == amp and toks[i + 1] in (RUST.kinds["const"], RUST.kinds["mut"])):
            toks[i] = _RUST_SOFT[k]
    return toks, frozenset()


RUST_2015 = Grammar(_RUST_RULES + """
    FnParam = Attr* Type ;
    """, ("File",))
# Words that the edition of 2015 reads as names.
_RUST_NAMES = dict.fromkeys((RUST.kinds["async"], RUST.kinds["await"]), RUST.kinds["ID"])


def lex_rust_2015(text: str):
    """Tokens of the edition of 2015, in which `async` and `await` are names and parameters of traits need none."""
    return [_RUST_NAMES.get(k, k) for k in lex_rust(text)[0]], frozenset()


_RUST_PLAIN = re.compile(r"/\*|\*/|//[^\n]*|b?r(\#*)\".*?\"\1|b?r\#+\".*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'", re.S)


def _nested_comments(text: str) -> str:
    out, depth, last, i = [], 0, 0, 0
    while True:
        m = _RUST_PLAIN.search(text, i)
        if not m:
            break
        i = m.end()
        if depth:
            if m[0] == "/*":
                depth += 1
            elif m[0] == "*/":
                depth -= 1
                if not depth:
                    out.append("\n" * text.count("\n", last, i) or " ")
                    last = i
            else:
                i = m.start() + (2 if m[0][:2] == "//" and m[0][2:3] != "*" else 1)
        elif m[0] == "/*":
            out.append(text[last : m.start()])
            last, depth = m.start(), 1
        elif m[0] == "*/":
            raise ValueError(m.start())
    if depth:
        raise ValueError(last)
    return "".join([*out, text[last:]])


# ---------------------------------------------------------------- Java

JAVA = Grammar(
    """
    File = ( Annotations 'package' QName ';' )? Import* TypeTop* ;
    Annotations = Annotation* ;
    Import = 'import' 'static'? QName ( '.' '*' )? ';' | ';' ;
    QName = Id ( '.' Id )* ;
    Id = ID | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'module' | 'when' | 'non' ;
    TypeTop = TypeDecl | ';' ;
    TypeDecl = Mods ( Class | Interface | EnumDecl | Record | AnnoDecl ) ;
    Mods = Mod* ;
    Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Annotation ;
    Annotation = '@' QName ( '(' ( ElemVal | Id '=' ElemVal ( ',' Id '=' ElemVal )* )? ')' )? ;
    ElemVal = Ternary | '{' ( ElemVal ( ',' ElemVal )* )? ','? '}' | Annotation ;
    Class = 'class' Id TypeParams? ( 'extends' Type )? ( 'implements' Types )? ( 'permits' Types )? Body ;
    Record = 'record' Id TypeParams? '(' ( RecParam ( ',' RecParam )* )? ')' ( 'implements' Types )? Body ;
    RecParam = Mods Type '...'? Id ;
    Interface = 'interface' Id TypeParams? ( 'extends' Types )? ( 'permits' Types )? Body ;
    AnnoDecl = '@' 'interface' Id Body ;
    EnumDecl = 'enum' Id ( 'implements' Types )? '{' ( EnumConst ( ',' EnumConst )* )? ','? ( ';' Member* )? '}' ;
    EnumConst = Annotations Id ( '(' Args ')' )? Body? ;
    Types = Type ( ',' Type )* ;
    TypeParams = '<' TypeParam ( ',' TypeParam )* '>' ;
    TypeParam = Annotations Id ( 'extends' Type ( '&' Type )* )? ;
    Body = '{' Member* '}' ;
    Member = ';' | 'static'? Block | TypeDecl | Mods TypeParams? Type Id '(' Params ')' Dims Throws? ( Block | 'default' ElemVal ';' | ';' ) | Mods TypeParams? Id '(' Params ')' Throws? Block | Mods Id Block | Mods Type Vars ';' ;
    Throws = 'throws' Types ;
    Dims = ( Annotations '[' ']' )* ;
    Params = ( Param ( ',' Param )* )? ;
    Param = Mods Type '...'? ( Id | 'this' | Id '.' 'this' ) Dims ;
    Vars = Var ( ',' Var )* ;
    Var = Id Dims ( '=' Init )? ;
    Init = Expr | ArrayInit ;
    ArrayInit = '{' ( Init ( ',' Init )* )? ','? '}' ;
    Type = Annotations ( Prim | ClassType ) Dims ;
    Prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void' ;
    ClassType = Id TypeArgs? ( '.' Annotations Id TypeArgs? )* ;
    TypeArgs = '<' ( TypeArg ( ',' TypeArg )* )? '>' ;
    TypeArg = Type | Annotations '?' ( ( 'extends' | 'super' ) Type )? ;
    Block = '{' Stmt* '}' ;
    Stmt = Block | ';' | Local ';' | TypeDecl | Id ':' Stmt | 'if' '(' Expr ')' Stmt ( 'else' Stmt )? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForHead ')' Stmt | 'return' Expr? ';' | 'break' Id? ';' | 'continue' Id? ';' | 'throw' Expr ';' | 'try' Resources? Block Catch* ( 'finally' Block )? | SwitchE | 'synchronized' '(' Expr ')' Block | 'assert' Expr ( ':' Expr )? ';' | 'yield' Expr ';' | StmtExpr ';' ;
    StmtExpr = Expr ;
    Local = Mods Type Vars ;
    ForHead = ( Local | Exprs )? ';' Expr? ';' Exprs? | Mods Type Id ':' Expr ;
    Resources = '(' Res ( ';' Res )* ';'? ')' ;
    Res = Mods Type Id '=' Expr | Expr ;
    Catch = 'catch' '(' Mods Type ( '|' Type )* Id ')' Block ;
    SwitchE = 'switch' '(' Expr ')' '{' Case* '}' ;
    Case = ( 'case' CaseLabel ( ',' CaseLabel )* ( 'when' Expr )? | 'default' ) ( ':' Stmt* | '->' ( Expr ';' | Block | 'throw' Expr ';' ) ) ;
    CaseLabel = Ternary | 'default' | Pattern ;
    Pattern = Mods Type Id | Type '(' ( Pattern ( ',' Pattern )* )? ')' Id? ;
    Exprs = Expr ( ',' Expr )* ;
    Args = Exprs? ;
    Expr = Ternary ( AssignOp Expr )? | Lambda ;
    Ternary = Binary ( '?' Expr ':' ( Ternary | Lambda ) )? ;
    AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
    Lambda = ( Id | '(' ( Id ( ',' Id )* )? ')' | '(' Params ')' ) '->' ( Expr | Block ) ;
    Binary = Unary ( BinOp Unary | 'instanceof' ( Type | Pattern ) )* ;
    BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
    Unary = ( '+' | '-' | '!' | '~' | '++' | '--' )* ( Postfix | Cast ) ;
    Cast = '(' Type ( '&' Type )* ')' ( Unary | Lambda ) ;
    Postfix = Primary Suffix* ;
    Suffix = '.' TypeArgs? Id | '.' 'this' | '.' 'class' | '.' 'super' | '.' New | '[' Expr ']' | '(' Args ')' | '++' | '--' | '::' TypeArgs? ( Id | 'new' ) ;
    Primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | Id | '(' Expr ')' | New | SwitchE | Prim Dims ( '.' 'class' | '::' 'new' ) | Id '[' ']' Dims ( '.' 'class' | '::' 'new' ) | ClassType '::' ( Id | 'new' ) ;
    New = 'new' TypeArgs? Annotations ( Prim | ClassType ) ( '(' Args ')' Body? | ( '[' Expr ']' )+ Dims | '[' ']' Dims ArrayInit ) ;
    """,
    ("File",),
)
_JAVA_LEX = Lexer(
    rf"(?P<w>[ \t\r\f]+|//[^\n]*|{_BLOCK})|(?P<n>\n)|(?P<i>(?:{_ID}|\$)[\w$]*)|(?P<num>{_NUM})|(?P<str>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|{_DQ})|(?P<chr>'(?:[^'\\\n]|\\(?:[btnfrs0-7\\'\"][0-7]{{0,2}}|u+[0-9a-fA-F]{{4}}))')"
    r"|(?P<o>\.\.\.|<<=|<<|->|::|\+\+|--|&&|\|\||[-+*/%^&|=!<>]=|[-+*/%^!&|=<>@.,;:?~(){}\[\]])",
    "package import static public private protected final abstract native synchronized transient volatile strictfp default sealed non class interface enum record extends implements permits throws this super int long short byte char boolean float double void if else while do for return break continue throw try catch finally switch case assert yield when instanceof new true false null var module",
    JAVA, {"num": "NUM", "str": "STR", "chr": "CHAR"},
)


def lex_java(text: str):
    return _JAVA_LEX.plain(text), frozenset()


# Words that older levels of the language read as names.
_JAVA_NAMES = dict.fromkeys((JAVA.kinds["enum"], JAVA.kinds["assert"]), JAVA.kinds["ID"])


def lex_old_java(text: str):
    """Before 5 `enum`, before 1.4 `assert` was a name."""
    return [_JAVA_NAMES.get(k, k) for k in _JAVA_LEX.plain(text)], frozenset()


# ---------------------------------------------------------------- C

C = Grammar(
    """
    File = External* ;
    Knr = External* ;
    External = ';' | FuncDef | Decl | 'asm' '(' STR ')' ';' | ID '(' MacroArgs ')' ';'? | 'extern' STR '{' External* '}' ;
    MacroArgs = ( MacroArg ( ',' MacroArg )* )? ;
    MacroArg = Expr | TypeName ;
    FuncDef = Specs Declarator Attrs Block ;
    Specs = Spec+ ;
    Spec = 'static' | 'extern' | 'typedef' | 'register' | 'auto' | 'inline' | 'const' | 'volatile' | 'restrict' | '_Thread_local' | '_Noreturn' | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | StructSpec | EnumSpec | ID | Attr | ( 'typeof' | 'typeof_unqual' ) '(' ( Expr | TypeName ) ')' | 'constexpr' | '_BitInt' '(' Ternary ')' | '_Alignas' '(' ( Expr | TypeName ) ')' | '_Atomic' ;
    Attr = '__attribute__' '(' '(' ( AttrItem ( ',' AttrItem )* )? ')' ')' | StdAttr ;
    StdAttr = '[' '[' ( StdItem? ( ',' StdItem? )* ) ']' ']' ;
    StdItem = ID ( '::' ID )? ( '(' MacroArgs ')' )? ;
    AttrItem = ( ID | 'const' ) ( '(' MacroArgs ')' )? ;
    Attrs = Attr* ;
    StructSpec = ( 'struct' | 'union' ) Attrs ( ID? '{' Member* '}' | ID ) Attrs ;
    Member = Specs ( MemDecl ( ',' MemDecl )* )? ';' | ';' | StaticAssert ;
    MemDecl = Declarator ( ':' Ternary )? Attrs | ':' Ternary ;
    EnumSpec = 'enum' Attrs ( ID? ( ':' Specs )? '{' Enumr ( ',' Enumr )* ','? '}' | ID ) ;
    Enumr = ID ( '=' Ternary )? ;
    Decl = Specs ( InitDecl ( ',' InitDecl )* )? ';' | StaticAssert ;
    StaticAssert = '_Static_assert' '(' Ternary ( ',' STR+ )? ')' ';' ;
    InitDecl = Declarator ( 'asm' '(' STR ')' )? Attrs ( '=' Init )? ;
    Init = Assign | '{' ( InitItem ( ',' InitItem )* ','? )? '}' ;
    InitItem = ( ( '[' Ternary ( '...' Ternary )? ']' | '.' ID )+ '=' )? Init ;
    Declarator = Ptr* Direct ;
    Ptr = '*' ( 'const' | 'volatile' | 'restrict' | '_Atomic' | Attr )* ;
    Direct = ( ID | '(' Attrs Declarator ')' ) DSuffix* ;
    DSuffix = '[' ( 'static' | 'const' | 'restrict' | 'volatile' )* ( Assign | '*' )? ']' | '(' Params ')' ;
    Params = ( Param ( ',' Param )* ( ',' '...' )? )? ;
    Param = Specs ( Declarator | Abstract )? Attrs ;
    Abstract = Ptr+ ADirect? | ADirect ;
    ADirect = ( '(' Abstract ')' | ASuffix ) ASuffix* ;
    ASuffix = '[' Assign? ']' | '(' Params ')' ;
    TypeName = Specs Abstract? ;
    Block = '{' BlockItem* '}' ;
    BlockItem = Decl | Stmt | FuncDef ;
    Stmt = Block | ';' | Expr ';' | ID ':' Attrs ( Stmt | Decl )? | StdAttr+ Stmt | 'case' Ternary ( '...' Ternary )? ':' ( Stmt | Decl )? | 'default' ':' ( Stmt | Decl )? | 'if' '(' Expr ')' Stmt ( 'else' Stmt )? | 'switch' '(' Expr ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ( Decl | Expr? ';' ) Expr? ';' Expr? ')' Stmt | 'goto' ( ID | '*' Expr ) ';' | 'continue' ';' | 'break' ';' | 'return' Expr? ';' | 'asm' ( 'volatile' | 'goto' )* '(' AsmPart ( ( ':' | '::' ) AsmPart? )* ')' ';' ;
    AsmPart = ( STR+ ( '(' Expr ')' )? | '[' ID ']' STR '(' Expr ')' ) ( ',' AsmPart )? ;
    Expr = Assign ( ',' Assign )* ;
    Assign = Ternary ( AssignOp Init )? ;
    AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
    Ternary = Binary ( '?' Expr? ':' Ternary )? ;
    Binary = Unary ( BinOp Unary )* ;
    BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' ;
    Unary = ( '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '&&' )* ( Postfix | Cast | SizeOf ) ;
    SizeOf = ( 'sizeof' | '_Alignof' ) ( Unary | '(' TypeName ')' ) ;
    Cast = '(' TypeName ')' ( Unary | '{' ( InitItem ( ',' InitItem )* ','? )? '}' Suffix* ) ;
    Postfix = Primary Suffix* ;
    Suffix = '[' Expr ']' | '(' ( CallArg ( ',' CallArg )* )? ')' | '.' ID | '->' ID | '++' | '--' ;
    CallArg = Assign | CallType ;
    CallType = CallSpec+ Ptr+ | CallWord Ptr* ;
    CallSpec = 'const' | 'unsigned' | 'signed' | 'struct' | ID | CallWord ;
    CallWord = 'int' | 'char' | 'long' | 'short' | 'float' | 'double' | 'void' | 'unsigned' | 'signed' | 'struct' ID | 'union' ID | 'enum' ID ;
    Primary = ID | NUM | CHAR | StrCat | '(' Expr ')' | '(' Block ')' | Generic ;
    StrCat = ( STR | ID STR )  ( STR | ID STR )* ID? ;
    Generic = '_Generic' '(' Assign ( ',' ( TypeName | 'default' ) ':' Assign )+ ')' ;
    FuncDef = KnrDef ;
    KnrDef = Specs Ptr* ID '(' ID ( ',' ID )* ')' Decl+ Block ;
    """,
    ("File", "Knr"),
)
_C_LEX = Lexer(
    rf"(?P<w>[ \t\r\f]+|\\\r?\n|//[^\n]*|{_BLOCK})|(?P<n>\n)|(?P<str>(?:u8|[uUL])?{_DQ})|(?P<chr>[uUL]?'(?:[^'\\\n]|\\.)+')|(?P<i>{_ID})|(?P<num>{_NUM})"
    r"|(?P<o>\.\.\.|<<=|>>=|<<|>>|->|\+\+|--|&&|\|\||::|[-+*/%^&|=!<>]=|[-+*/%^!&|=<>.,;:?~(){}\[\]])",
    "static extern typedef register auto inline const volatile restrict _Thread_local _Noreturn void char short int long float double signed unsigned _Bool _Complex struct union enum typeof typeof_unqual constexpr _BitInt _Alignas _Alignof _Atomic __attribute__ asm case default if else switch while do for goto continue break return sizeof _Static_assert _Generic",
    C, {"num": "NUM", "str": "STR", "chr": "CHAR"},
)
_C_ALIAS = {"__inline": "inline", "__inline__": "inline", "__const": "const", "__volatile__": "volatile", "__restrict": "restrict", "__asm__": "asm", "__asm": "asm", "__extension__": "", "__typeof__": "typeof", "_Static_assert": "_Static_assert", "static_assert": "_Static_assert", "alignas": "_Alignas", "alignof": "_Alignof", "thread_local": "_Thread_local"}
for _a, _b in _C_ALIAS.items():
    if _b:
        _C_LEX.words[_a] = C.kinds[_b]
_C_HIDE = re.compile(rf"{_BLOCK}|(?P<u>/\*)|//[^\n]*|{_DQ}|(?P<d>^[ \t]*\#[ \t]*(?P<k>\w*)(?P<r>(?:\\\r?\n|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|[^\n])*))", re.M | re.S)
# The directives of the C preprocessor.
_DIRECTIVES = frozenset("include include_next embed import define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident".split()) | {""}


def _c_pieces(text: str):
    """(pieces, conditions): stretches between directives as (from, to, ((condition, arm), ...)), and per condition how its #if reads.

    Directives are checked by themselves (form, nesting of conditions) and belong to no piece.
    """
    pieces, conditions, last, path, closed = [], [], 0, [], []
    for m in _C_HIDE.finditer(text):
        if m["u"]:
            raise ValueError(m.start())
        if m["d"] is None:
            continue
        if m.end() == len(text) and re.search(r"/\*(?!.*\*/)", m["r"], re.S):
            raise ValueError(m.start())
        k, rest = m["k"], m["r"].strip()
        if k not in _DIRECTIVES:
            raise ValueError(m.start())
        if k == "include" and not re.match(r"<[^<>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*", rest) or k in ("define", "undef", "ifdef", "ifndef") and not re.match(r"[^\W\d]\w*", rest) or k in ("if", "elif") and not rest:
            raise ValueError(m.start())
        pieces.append((last, m.start(), tuple(path)))
        last = m.end()
        if k in ("if", "ifdef", "ifndef"):
            path.append((len(conditions), 0))
            closed.append(False)
            conditions.append((k, " ".join(rest.split())))
        elif k in ("elif", "else", "elifdef", "elifndef"):
            if not path or closed[-1]:
                raise ValueError(m.start())
            closed[-1] = k == "else"
            path[-1] = (path[-1][0], path[-1][1] + 1)
        elif k == "endif":
            if not path:
                raise ValueError(m.start())
            path.pop()
            closed.pop()
    if path:
        raise ValueError(len(text))
    return [*pieces, (last, len(text), ())], conditions


def _c_text(text: str, pieces, choice: dict[int, int]) -> str:
    """The text with one arm of each condition: the chosen one, else the first."""
    return "\n".join(text[i:j] for i, j, path in pieces if all(choice.get(c, 0) == arm for c, arm in path)) if len(pieces) > 1 else text


def lex_c(text: str):
    """Of #if ... #elif ... #else ... #endif the first branch is read, so that both arms needn't form one text."""
    return _C_LEX.plain(_c_text(text, _c_pieces(text)[0], {})), frozenset()


def c_arm_without_derivation(text: str, lexer: Lexer, grammar: Grammar) -> int | None:
    """Where an arm behind a condition's first one begins that no choice of the other conditions' arms makes derivable.

    Tried are the same arm of all conditions that have it, then the arm alone, then the same arm of all conditions that
    read alike (one without that arm is then left out), then the arm with conditions of a single arm left out.
    """
    pieces, conditions = _c_pieces(text)
    arms: dict[tuple, int] = {}
    for i, j, path in pieces:
        if any(arm for _, arm in path) and text[i:j].strip():
            arms.setdefault(path, i)
    most: dict[int, int] = {}
    for _, _, path in pieces:
        for c, arm in path:
            most[c] = max(most.get(c, 0), arm)

    def derived(choice: dict[int, int]) -> bool:
        try:
            toks = lexer.plain(_c_text(text, pieces, choice))
        except ValueError:
            return False
        return bool(grammar.accepts(toks)[0])

    for arm in sorted({arm for path in arms for _, arm in path if arm}):
        choice = {c: arm for c, n in most.items() if n >= arm}
        held = [path for path in arms if all(choice.get(c, 0) == x for c, x in path)]
        if held and derived(choice):
            for path in held:
                del arms[path]
    for path, at in arms.items():
        alike = {x: arm for c, arm in path if arm for x, how in enumerate(conditions) if how == conditions[c]}
        single = {x: 1 for x, n in most.items() if n == 0}
        if not any(derived(choice | dict(path)) for choice in ({}, alike, single, single | alike)):
            return at
    return None


# ---------------------------------------------------------------- C++

CPP = Grammar(
    """
    File = Top* ;
    Top = ';' | Decl | 'export'? 'module' QName? ';' | 'export'? 'import' ( QName | STR ) ';' | 'export' ( Decl | '{' Top* '}' ) ;
    Decl = Namespace | Using | Template | 'extern' STR ( '{' Top* '}' | Decl ) | StaticAssert | FuncDef | Simple | Binding | ID '(' MacroArgs ')' ';'? | 'asm' '(' STR+ ')' ';' | 'extern'? 'template' Simple | Guide ;
    Namespace = 'inline'? 'namespace' Attr* ( ID ( '::' 'inline'? ID )* )? Attr* '{' Top* '}' | 'namespace' ID '=' QName ';' ;
    Using = 'using' 'namespace' QName ';' | 'using' 'typename'? QName '...'? ( ',' 'typename'? QName '...'? )* ';' | 'using' ID Attr* '=' TypeId ';' | 'using' 'enum' QName ';' ;
    Template = 'template' '<' ( TParam ( ',' TParam )* )? '>' Requires? ( Decl | 'concept' ID '=' Expr ';' ) ;
    TParam = ( 'typename' | 'class' ) '...'? ID? ( '=' TypeId )? | 'template' '<' ( TParam ( ',' TParam )* )? '>' ( 'typename' | 'class' ) '...'? ID? ( '=' QName )? | Param ;
    Requires = 'requires' Constraint ( ( '&&' | '||' ) Constraint )* ;
    Constraint = QName | '(' Expr ')' | RequiresExpr | 'true' | 'false' ;
    RequiresExpr = 'requires' ( '(' Params ')' )? '{' Requirement* '}' ;
    Requirement = Expr ';' | 'typename' QName ';' | '{' Expr '}' 'noexcept'? ( '->' TypeId )? ';' | Requires ';' ;
    Guide = 'explicit'? ID '(' Params ')' '->' QName ';' ;
    StaticAssert = 'static_assert' '(' Assign ( ',' STR+ )? ')' ';' ;
    MacroArgs = ( MacroArg ( ',' MacroArg )* )? ;
    MacroArg = Assign | TypeId | Braces ;
    Attr = '[' '[' ( 'using' ID ':' )? ( AttrItem? ( ',' AttrItem? )* ) ']' ']' | '__attribute__' '(' '(' ( AttrItem ( ',' AttrItem )* )? ')' ')' | 'alignas' '(' ( Expr | TypeId ) ')' | '__declspec' '(' MacroArgs ')' ;
    AttrItem = ( ID | 'const' ) ( '::' ID )? ( '(' MacroArgs ')' )? '...'? ;
    Specs = Spec+ ;
    Spec = 'static' | 'extern' | 'typedef' | 'register' | 'inline' | 'virtual' | 'explicit' ( '(' Expr ')' )? | 'friend' | 'constexpr' | 'consteval' | 'constinit' | 'mutable' | 'thread_local' | 'const' | 'volatile' | 'auto' | Word | 'decltype' '(' Expr ')' | 'typename' QName | ClassSpec | EnumSpec | QName | Attr ;
    Word = 'void' | 'char' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' ;
    QName = '::'? QSeg ( '::' 'template'? QSeg )* ;
    QSeg = ID TArgs? | '~' ID | 'operator' OpName TArgs? | 'decltype' '(' Expr ')' ;
    TArgs = '<' ( TArg ( ',' TArg )* )? '>' ;
    TArg = ( TypeId | Ternary ) '...'? ;
    OpName = BinOp | AssignOp | '!' | '~' | '++' | '--' | ',' | '->' | '->*' | '(' ')' | '[' ']' | ( 'new' | 'delete' ) ( '[' ']' )? | STR ID? | 'co_await' | 'const'* ( Word+ | QName | 'auto' ) 'const'? PtrOp* ;
    ClassSpec = ( 'class' | 'struct' | 'union' ) ( Attr | ID ( '(' MacroArgs ')' )? )* ( QName ID? )? ( ':' Base ( ',' Base )* )? '{' Member* '}' | ( 'class' | 'struct' | 'union' ) Attr* QName ;
    Base = ( 'virtual' | Access | Attr )* ( QName | 'decltype' '(' Expr ')' ) '...'? ;
    Access = 'public' | 'private' | 'protected' ;
    Member = Access ID? ':' | Decl | ';' ;
    EnumSpec = 'enum' ( 'class' | 'struct' )? Attr* QName? ( ':' TypeId )? '{' ( Enumr ( ',' Enumr )* ','? )? '}' | 'enum' ( 'class' | 'struct' )? QName ( ':' TypeId )? ;
    Enumr = ID Attr* ( '=' Ternary )? ;
    Simple = Attr* Specs? ( InitDecl ( ',' InitDecl )* )? ';' ;
    Binding = Attr* Specs ( '&' | '&&' )? '[' ID ( ',' ID )* ']' Init ';' ;
    InitDecl = Declarator ( 'asm' '(' STR ')' )? Attr* Init? | Declarator? ':' Ternary Init? ;
    Init = '=' ( Assign | Braces | 'default' | 'delete' ( '(' STR ')' )? ) | Braces | '(' Args ')' ;
    Declarator = PtrOp* Direct ;
    PtrOp = '*' ( 'const' | 'volatile' | ID | Attr )* | '&' Attr* | '&&' Attr* | QName '::' '*' ( 'const' | 'volatile' )* ;
    Direct = ( '...'? QName Attr* | '(' Attr* ID? Declarator ')' ) DSuffix* ;
    DSuffix = '[' Expr? ']' Attr* | '(' Params ')' FnTail* ;
    FnTail = 'const' | 'volatile' | '&' | '&&' | 'noexcept' ( '(' Expr ')' )? | 'throw' '(' ( TypeId ( ',' TypeId )* )? ')' | '->' TypeId | Requires | Attr | ID ( '(' MacroArgs ')' )? ;
    Params = ( Param ( ',' Param )* '...'? ( ',' '...' )? )? | '...' ;
    Param = Attr* 'this'? Specs ( Declarator | Abstract )? Attr* ( '=' ( Assign | Braces ) )? ;
    Abstract = PtrOp+ ( ADirect | '...' )? | ADirect | '...' ;
    ADirect = ( '(' Abstract ')' | ASuffix ) ASuffix* ;
    ASuffix = '[' Expr? ']' | '(' Params ')' FnTail* ;
    TypeId = Specs Abstract? ;
    FuncDef = Attr* Specs? Declarator ( CtorInit? Block | 'try' CtorInit? Block Catch+ ) ;
    CtorInit = ':' MemInit ( ',' MemInit )* ;
    MemInit = QName ( '(' Args ')' | Braces ) '...'? ;
    Block = '{' Stmt* '}' ;
    Stmt = Block | ';' | Expr ';' | Simple | Binding | Using | StaticAssert | Attr+ Stmt | ID ':' Stmt? | 'case' Ternary ( '...' Ternary )? ':' Stmt? | 'default' ':' Stmt? | 'if' ( 'constexpr' | '!'? 'consteval' )? ( '(' Cond ')' )? Stmt ( 'else' Stmt )? | 'switch' '(' Cond ')' Stmt | 'while' '(' Cond ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForHead ')' Stmt | 'goto' ( ID | '*' Expr ) ';' | 'break' ';' | 'continue' ';' | ( 'return' | 'co_return' ) ( Expr | Braces )? ';' | 'try' Block Catch+ | 'asm' 'volatile'? '(' AsmPart ( ( ':' | '::' ) AsmPart? )* ')' ';' | 'namespace' ID '=' QName ';' | ID '(' MacroArgs ')' Block ;
    AsmPart = ( STR+ ( '(' Expr ')' )? | '[' ID ']' STR '(' Expr ')' ) ( ',' AsmPart )? ;
    Cond = ( Simple | Expr ';' | ';' | Using )? ( Expr | Attr* Specs Declarator Init | Specs ( '&' | '&&' )? '[' ID ( ',' ID )* ']' Init ) ;
    ForHead = ( Simple | Binding | Expr? ';' | Using ) Cond? ';' Expr? | ( Simple | Expr ';' )? Attr* Specs ( Declarator | ( '&' | '&&' )? '[' ID ( ',' ID )* ']' ) ':' ( Expr | Braces ) ;
    Catch = 'catch' '(' ( Param | '...' ) ')' Block ;
    Expr = Assign ( ',' Assign )* ;
    Assign = Ternary ( AssignOp ( Assign | Braces ) )? | 'throw' Assign? | 'co_yield' ( Assign | Braces ) ;
    AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' ;
    Ternary = Binary ( '?' Expr? ':' Assign )? ;
    Binary = Unary ( BinOp Unary )* ;
    BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%' | '.*' | '->*' ;
    Unary = ( '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '&&' | 'co_await' | '__extension__' )* ( Postfix | Cast | SizeOf | New | '::'? 'delete' ( '[' ']' )? Unary ) ;
    SizeOf = ( 'sizeof' | 'alignof' ) ( Unary | '(' TypeId ')' ) | 'sizeof' '...' '(' ID ')' | 'noexcept' '(' Expr ')' ;
    Cast = '(' TypeId ')' ( Unary | Braces ) ;
    New = '::'? 'new' ( '(' Args ')' )? ( NewType | '(' TypeId ')' ) ( '(' Args ')' | Braces )? ;
    NewType = 'const'* ( Word+ | 'auto' | 'typename'? QName ) PtrOp* ( '[' Expr? ']' )* ;
    Postfix = Primary Suffix* ;
    Suffix = '[' ( Expr | Braces )? ']' | '(' Args ')' | Braces | ( '.' | '->' ) 'template'? QName | '++' | '--' ;
    Braces = '{' ( InitItem ( ',' InitItem )* ','? )? '}' ;
    InitItem = ( ( '.' ID | '[' Ternary ']' )+ '='? )? ( Assign | Braces ) '...'? ;
    Args = ( Arg ( ',' Arg )* )? ;
    Arg = ( Assign | Braces | Word+ PtrOp* | 'const' Specs Abstract? | 'struct' QName ) '...'? ;
    Primary = QName | NUM | CHAR | StrCat | 'this' | 'true' | 'false' | 'nullptr' | '(' ( Expr | Fold | Block ) ')' | Lambda | ( 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' ) '<' TypeId '>' '(' Expr ')' | 'typeid' '(' ( Expr | TypeId ) ')' | ( Word | 'auto' ) ( '(' Args ')' | Braces ) | 'typename' QName ( '(' Args ')' | Braces ) | RequiresExpr ;
    StrCat = ( STR | ID STR ) ( STR | ID STR )* ID? ;
    Fold = '...' BinOp Unary | Binary BinOp '...' ( BinOp Unary )? | Binary ',' '...' | '...' ',' Binary ;
    Lambda = '[' ( Capture ( ',' Capture )* )? ']' ( '<' ( TParam ( ',' TParam )* )? '>' Requires? )? Attr* ( '(' Params ')' )? ( 'mutable' | 'constexpr' | 'consteval' | 'static' | FnTail )* Block ;
    Capture = '&' | '=' | '*'? 'this' | '&'? '...'? ID '...'? ( '=' Assign | Braces | '(' Args ')' )? ;
    """,
    ("File",),
)
_CPP_LEX = Lexer(
    rf"(?P<w>[ \t\r\f]+|\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\)*|{_BLOCK})|(?P<n>\n)|(?P<str>(?:u8|[uUL])?R\"(?P<d>[^\s()\\]{{0,16}})\(.*?\)(?P=d)\"\w*|(?:u8|[uUL])?{_DQ}(?:_\w+|(?:s|sv|h|min|ms|us|ns)\b)?)|(?P<chr>(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'(?:_\w+)?)|(?P<i>{_ID})"
    r"|(?P<num>(?:0[xX][0-9a-fA-F']*\.?[0-9a-fA-F']*(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)\w*)"
    r"|(?P<o>\.\.\.|<=>|<<=|<<|->\*|->|\.\*|\+\+|--|&&|\|\||::|[-+*/%^&|=!<>]=|[-+*/%^!&|=<>.,;:?~(){}\[\]])",
    "export module import namespace inline using typename template class concept requires explicit static_assert __attribute__ alignas __declspec const static extern typedef register virtual friend constexpr consteval constinit mutable thread_local volatile auto decltype void char wchar_t char8_t char16_t char32_t short int long float double signed unsigned bool operator new delete co_await struct union public private protected enum default asm noexcept throw this try case if else switch while do for goto break continue return co_return catch co_yield sizeof alignof true false nullptr static_cast dynamic_cast const_cast reinterpret_cast typeid __extension__",
    CPP, {"num": "NUM", "str": "STR", "chr": "CHAR"},
)
# Words that are names unless a module or concept is declared.
_CPP_SOFT = {CPP.kinds[k]: CPP.kinds["ID"] for k in ("module", "import")}
# Other spellings of C++ words and operators.
_CPP_LEX.words |= {a: CPP.kinds[b] for a, b in {"and": "&&", "or": "||", "not": "!", "__asm__": "asm", "__inline": "inline", "__inline__": "inline", "__restrict": "const", "__restrict__": "const", "_Static_assert": "static_assert", "__volatile__": "volatile"}.items()}


def lex_cpp(text: str):
    """Conditions as in C; `module` and `import` are words at the start of a declaration only."""
    toks = _CPP_LEX.plain(_c_text(text, _c_pieces(text)[0], {}))
    before = {CPP.kinds[";"], CPP.kinds["}"], CPP.kinds["export"]}
    for i, k in enumerate(toks):
        if k in _CPP_SOFT and i and toks[i - 1] not in before:
            toks[i] = _CPP_SOFT[k]
    return toks, frozenset()


# ---------------------------------------------------------------- JavaScript and TypeScript

_JS_COMMON = """
    Term = ';' | @newline ;
    Stmts = Stmt* ;
    Stmt = Block | ';' | VarStmt | Func | Class | 'if' '(' Exprs ')' Stmt ( 'else' Stmt )? | 'for' 'await'? '(' ForHead ')' Stmt | 'while' '(' Exprs ')' Stmt | 'do' Stmt 'while' '(' Exprs ')' ';'? | 'return' Exprs? Term | 'break' Id? Term | 'continue' Id? Term | 'throw' Exprs Term | 'try' Block ( 'catch' ( '(' Binding TypeAnn? ')' )? Block )? ( 'finally' Block )? | 'switch' '(' Exprs ')' '{' ( ( 'case' Exprs | 'default' ) ':' Stmts )* '}' | Id ':' Stmt | 'debugger' Term | Exprs Term ;
    Block = '{' Stmts '}' ;
    VarStmt = ( 'var' | 'let' | 'const' ) Vars Term ;
    Vars = Var ( ',' Var )* ;
    Var = Binding Definite? TypeAnn? ( '=' Expr )? ;
    ForHead = ( ( 'var' | 'let' | 'const' ) Vars | Exprs )? ';' Exprs? ';' Exprs? | ( 'var' | 'let' | 'const' ) Binding ( 'of' | 'in' ) Exprs | Postfix ( 'of' | 'in' ) Exprs ;
    Binding = Id | '[' ( BindElem? ( ',' BindElem? )* ) ']' | '{' ( BindProp ( ',' BindProp )* ','? )? '}' ;
    BindElem = '...'? Binding ( '=' Expr )? ;
    BindProp = Id ( '=' Expr )? | PropName ':' Binding ( '=' Expr )? | '...' Binding ;
    Func = 'async'? 'function' '*'? Id TypeParams? Params ReturnAnn? Body ;
    Body = Block ;
    Params = '(' ( Param ( ',' Param )* ','? )? ')' ;
    Param = Decorators ParamMods Binding Optional? TypeAnn? ( '=' Expr )? | Decorators '...' Binding TypeAnn? | This ;
    Class = Decorators 'class' Id? TypeParams? Heritage '{' Member* '}' ;
    Decorators = ( '@' DecoExpr )* ;
    DecoExpr = Id ( '.' IdName )* Call? | '(' Exprs ')' ;
    Call = TypeArgs? '(' Args ')' ;
    Member = ';' | Decorators Mods Method | Decorators Mods Prop Term | 'static' Block ;
    Method = ( 'async'? '*'? | 'get' | 'set' ) PropName Optional? TypeParams? Params ReturnAnn? MethodBody ;
    Prop = PropName Definite? Optional? TypeAnn? ( '=' Expr )? ;
    PropName = IdName | STR | NUM | '[' Expr ']' | PRIV ;
    Exprs = Expr ( ',' Expr )* ;
    Expr = Arrow | Cond ( AssignOp Expr )? | 'yield' '*'? Expr? ;
    AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '**=' | '&&=' | '||=' | '??=' ;
    Arrow = 'async'? ( Id | TypeParams? Params ReturnAnn? ) '=>' ( Body | Expr ) ;
    Cond = Binary ( '?' Expr ':' Expr )? ;
    Binary = Unary ( BinOp Unary )* ;
    BinOp = '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**' | 'instanceof' | 'in' ;
    Unary = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' )* ( Postfix ( '++' | '--' )? ) ;
    Postfix = Primary Suffix* ;
    Suffix = '.' ( IdName | PRIV ) | '?.' ( IdName | PRIV | '[' Exprs ']' | '(' Args ')' ) | '[' Exprs ']' | Call | Template ;
    Args = ( Arg ( ',' Arg )* ','? )? ;
    Arg = '...'? Expr ;
    Primary = Id | NUM | STR | REGEX | Template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Exprs ')' | '[' ArrayItems ']' | Object | FuncExpr | Class | New | 'import' ( '(' Args ')' | '.' 'meta' ) | PRIV 'in' Unary ;
    ArrayItems = Arg? ( ',' Arg? )* ;
    Object = '{' ( ObjProp ( ',' ObjProp )* ','? )? '}' ;
    ObjProp = PropName ':' Expr | Id ( '=' Expr )? | '...' Expr | Method ;
    FuncExpr = 'async'? 'function' '*'? Id? TypeParams? Params ReturnAnn? Body ;
    New = 'new' ( '.' 'target' | NewTarget NewArgs? ) ;
    NewTarget = ( Id | 'this' | '(' Exprs ')' | FuncExpr | Class | New ) ( '.' IdName | '[' Exprs ']' )* ;
    NewArgs = Call ;
    Template = TPL | THEAD Exprs ( TMID Exprs )* TTAIL ;
    Primary = Jsx ;
    Jsx = JLT JNAME JAttr* ( JSELF | JGT JChild* JEND JGT ) | JLT JGT JChild* JEND JGT ;
    JAttr = JNAME ( '=' ( STR | '{' Exprs '}' | Jsx ) )? | '{' '...' Expr '}' ;
    JChild = Jsx | '{' ( '...'? Exprs )? '}' ;
    Id = ID | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'type' | 'static' | 'let' | 'meta' | 'target' | 'await' | 'yield' | Soft ;
    Soft = 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'keyof' | 'is' | 'infer' | 'unique' | 'asserts' | 'satisfies' | 'public' | 'private' | 'protected' | 'override' | 'implements' | 'interface' | 'global' | 'any' | 'accessor' | 'require' ;
    IdName = Id | 'var' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'function' | 'class' | 'extends' | 'new' | 'this' | 'super' | 'null' | 'true' | 'false' | 'typeof' | 'void' | 'delete' | 'instanceof' | 'in' | 'import' | 'export' | 'enum' | 'debugger' | 'with' ;
    ModuleItem = Import | Export | Stmt ;
    Import = 'import' ( STR | ImportClause 'from' STR ) With? Term ;
    With = 'with' Object ;
    ImportClause = Id ( ',' ( '*' 'as' Id | Named ) )? | '*' 'as' Id | Named ;
    Named = '{' ( NamedItem ( ',' NamedItem )* ','? )? '}' ;
    NamedItem = ( IdName | STR ) ( 'as' ( IdName | STR ) )? ;
    Export = 'export' ( '*' ( 'as' ( IdName | STR ) )? 'from' STR Term | Named ( 'from' STR )? Term | VarStmt | Func | Class | 'default' ( AnonFunc | Class | Expr Term ) ) ;
    AnonFunc = 'async'? 'function' '*'? Id? TypeParams? Params ReturnAnn? Body ;
"""
JS = Grammar(
    _JS_COMMON
    + """
    Script = Stmts ;
    Module = ModuleItem* ;
    Heritage = ( 'extends' Postfix )? ;
    Mods = 'static'? 'accessor'? ;
    MethodBody = Body ;
    ParamMods = ? ; TypeParams = '<type>' ; TypeArgs = '<type>' ; TypeAnn = '<type>' ; ReturnAnn = '<type>' ; Optional = '<type>' ; Definite = '<type>' ; This = '<type>' ;
    Stmt = 'with' '(' Exprs ')' Stmt ;
    """.replace("ParamMods = ? ;", "ParamMods = | ;"),
    ("Script", "Module"),
)
TS = Grammar(
    _JS_COMMON
    + """
    Script = Stmts ;
    Module = ModuleItem* ;
    Heritage = ( 'extends' Postfix TypeArgs? )? ( 'implements' Type ( ',' Type )* )? ;
    Mods = ( 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor' | 'async' )* ;
    ParamMods = ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )* ;
    MethodBody = Body | Term ;
    Body = Term ;
    Optional = '?' ; Definite = '!' ;
    This = 'this' TypeAnn ;
    TypeParams = '<' TypeParam ( ',' TypeParam )* ','? '>' ;
    TypeParam = ( 'const' | 'in' | 'out' )* Id ( 'extends' Type )? ( '=' Type )? ;
    TypeArgs = '<' Type ( ',' Type )* '>' ;
    TypeAnn = ':' Type ;
    ReturnAnn = ':' ( Type | 'asserts'? ( Id | 'this' ) 'is' Type | 'asserts' ( Id | 'this' ) ) ;
    Type = UnionT ( 'extends' UnionT '?' Type ':' Type )? | FuncT ;
    FuncT = 'abstract'? 'new'? TypeParams? Params '=>' ( Type | 'asserts'? ( Id | 'this' ) 'is' Type ) ;
    UnionT = ( '|' | '&' )? PrefixT ( ( '|' | '&' ) PrefixT )* ;
    PrefixT = ( 'keyof' | 'unique' | 'readonly' | 'infer' )* PostT ;
    PostT = PrimT ( '[' Type? ']' )* ;
    PrimT = TName TypeArgs? | STR | NUM | '-' NUM | Template | 'this' | 'null' | 'void' | 'true' | 'false' | 'typeof' ( TName TypeArgs? | 'import' '(' STR ')' ) | '(' Type ')' | '[' ( TupleT ( ',' TupleT )* ','? )? ']' | ObjT | 'import' '(' STR ')' ( '.' IdName )* TypeArgs? ;
    TName = Id ( '.' IdName )* ;
    TupleT = '...'? ( IdName '?'? ':' )? Type '?'? ;
    ObjT = '{' ( ObjMem ( ( ';' | ',' | @newline ) ObjMem )* ( ';' | ',' )? )? '}' ;
    ObjMem = ( 'readonly' | '+' 'readonly' | '-' 'readonly' | 'get' | 'set' )? ( PropName '?'? TypeAnn? | PropName '?'? TypeParams? Params ReturnAnn? | '[' Id ':' Type ']' TypeAnn | '[' Id 'in' Type ( 'as' Type )? ']' ( '+' '?' | '-' '?' | '?' )? TypeAnn ) | 'new'? TypeParams? Params ReturnAnn? ;
    Stmt = TypeStmt | 'declare' ( VarStmt | Func | Class | TypeStmt | 'global' Block ) | 'abstract' Class ;
    TypeStmt = 'type' Id TypeParams? '=' Type Term | 'interface' Id TypeParams? ( 'extends' Type ( ',' Type )* )? ObjT | 'const'? 'enum' Id '{' ( EnumMem ( ',' EnumMem )* ','? )? '}' | ( 'namespace' | 'module' ) ( STR | Id ( '.' IdName )* ) ( '{' ModuleItem* '}' | Term ) ;
    EnumMem = PropName ( '=' Expr )? ;
    Member = Decorators Mods '[' Id ':' Type ']' TypeAnn Term ;
    Binary = Unary ( BinOp Unary | 'as' ( Type | 'const' ) | 'satisfies' Type )+ ;
    Suffix = '!' | TypeArgs ;
    Unary = '<' Type '>' Unary ;
    Import = 'import' 'type' ImportClause 'from' STR With? Term | 'import' 'type'? Id '=' ( 'require' '(' STR ')' | TName ) Term ;
    NamedItem = 'type' ( IdName | STR ) ( 'as' ( IdName | STR ) )? ;
    Export = 'export' ( 'type' ( Named | '*' ( 'as' IdName )? ) ( 'from' STR )? Term | TypeStmt | 'declare' ( VarStmt | Func | Class | TypeStmt ) | 'abstract' Class | '=' Expr Term | 'as' 'namespace' Id Term | 'default' ( TypeStmt | 'abstract' Class ) | 'import' Id '=' TName Term ) ;
    """,
    ("Script", "Module"),
)
_JS_KEYS = "async of get set from as type static let meta target await yield declare namespace module abstract readonly keyof is infer unique asserts satisfies public private protected override implements interface global accessor require var const if else for while do return break continue throw try catch finally switch case default function class extends new this super null true false typeof void delete instanceof in import export enum debugger with out"
_JS_PATTERN = (
    r"(?P<w>[ \t\r\f\v\xa0\ufeff]+|//[^\n\u2028\u2029]*)|(?P<c>/\*(?:[^*]|\*(?!/))*\*/)|(?P<bad>/\*.*)|(?P<n>[\n\u2028\u2029])|(?P<i>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*)|(?P<priv>\#[^\W\d][\w$]*)"
    rf"|(?P<num>{_NUM})|(?P<str>{_DQ}|{_SQ})|(?P<tpl>`)|(?P<slash>/=?)"
    r"|(?P<o>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|<<|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|[-+*%&|^]=|[-+*%&|^!~<>=?:;,.(){}\[\]@])"
)
_JS_RE = re.compile(_JS_PATTERN, re.S)
_TPL_PART = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_ELEMENT = re.compile(r"<(?=[>A-Za-z_$])")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
_ELEMENT_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_IN_TAG = re.compile(rf"(?P<blank>(?:\s|{_BLOCK}|//[^\n]*)+)|(?P<name>[A-Za-z_$][\w$.:-]*)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<end>/?>)|(?P<is>=)|(?P<open>\{{)|(?P<sub><)")


class JsLexer:
    """Tokens of JavaScript: a slash begins a pattern unless a value stands before it; templates nest.

    elements: whether a `<` where no value stands before it opens an element (JSX). What is open is kept in one stack,
    so texts may nest as deeply as they like.
    """

    def __init__(self, grammar: Grammar, elements: bool):
        self.kinds = k = grammar.kinds
        self.elements = elements
        self.words = {w: k[w] for w in _JS_KEYS.split() if w in k}
        values = ["ID", "NUM", "STR", "REGEX", "TPL", "TTAIL", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "JGT", "JSELF"]
        self.values = {k[x] for x in values if x in k} | {k[x] for x in ("of", "get", "set", "from", "as", "type", "static", "async", "any", "let") if x in k}
        self.known = _Known(_JS_RE, self.words, k, {"i": k["ID"], "c": -1, "priv": k["PRIV"], "num": k["NUM"], "str": k["STR"], "tpl": -3, "slash": -3})
        self.heads = {k[x] for x in ("if", "while", "for", "with") if x in k}

    def _element(self, text: str, i: int, out: list[int], nest: list) -> int:
        """Goes on inside an element that is open: a tag's attributes or what stands between two tags."""
        k = self.kinds
        if nest[-1][0] == "tag":
            m = _IN_TAG.match(text, i)
            if m is None:
                raise ValueError(i)
            g = m.lastgroup
            if g == "name":
                out.append(k["JNAME"])
            elif g == "str":
                out.append(k["STR"])
            elif g == "is":
                out.append(k["="])
            elif g == "open":
                out.append(k["{"])
                nest.append("{")
            elif g == "sub":
                return self._tag(text, i, out, nest)
            elif g == "end":
                _, name = nest.pop()
                if m[0] == ">":
                    out.append(k["JGT"])
                    nest.append(("within", name))
                else:
                    out.append(k["JSELF"])
            return m.end()
        j = i
        while j < len(text) and text[j] not in "<{":
            if text[j] in ">}":
                raise ValueError(j)
            cut = [x for x in (text.find(c, j + 1) for c in "<{>}") if x >= 0]
            j = min(cut, default=len(text))
        if j >= len(text):
            raise ValueError(i)
        if text[j] == "{":
            out.append(k["{"])
            nest.append("{")
            return j + 1
        if not text.startswith("</", j):
            return self._tag(text, j, out, nest)
        m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, j)
        if m is None or (m[1] or "") != nest[-1][1]:
            raise ValueError(j)
        nest.pop()
        out += [k["JEND"], k["JGT"]]
        return m.end()

    def _tag(self, text: str, i: int, out: list[int], nest: list) -> int:
        m = _ELEMENT_NAME.match(text, i + 1)
        out.append(self.kinds["JLT"])
        if m is None:
            if not text.startswith("<>", i):
                raise ValueError(i)
            nest.append(("within", ""))
            out.append(self.kinds["JGT"])
            return i + 2
        out.append(self.kinds["JNAME"])
        nest.append(("tag", m[0]))
        return m.end()

    def __call__(self, text: str):
        k, values, known, heads = self.kinds, self.values, self.known, self.heads
        text = re.sub(r"\A\ufeff?#![^\n]*", "", text)
        out, breaks, i, n, fresh, nest = [], set(), 0, len(text), False, []
        parens: list[bool] = []  # whether the bracket was opened after if/while/for, so that a pattern may follow it
        after_head = False
        less, curly, curled, round_, rounded = k["<"], k["{"], k["}"], k["("], k[")"]
        while i < n:
            if nest and nest[-1].__class__ is tuple:
                i = self._element(text, i, out, nest)
                after_head = fresh = False
                continue
            for m in _JS_RE.finditer(text, i):
                if m.start() != i:
                    raise ValueError(i)
                t = m[0]
                i = m.end()
                x = known[t]
                if x == -1:
                    if t[0] == "/" and t[1] == "*" and "\n" in t:
                        fresh = True
                    continue
                if x == -2:
                    fresh = True
                    continue
                if fresh:
                    breaks.add(len(out))
                    fresh = False
                if x == -3:
                    i = m.start()
                    if t == "`":
                        p = _TPL_PART.match(text, i + 1)
                        if p is None:
                            raise ValueError(i)
                        if p[1] == "`":
                            out.append(k["TPL"])
                        else:
                            out.append(k["THEAD"])
                            nest.append("`")
                        i = p.end()
                        break
                    if out and out[-1] in values and not (out[-1] == rounded and after_head):
                        out.append(k[t])
                        i = m.end()
                        after_head = False
                        continue
                    r = _REGEX.match(text, i)
                    if r is None:
                        raise ValueError(i)
                    out.append(k["REGEX"])
                    i = r.end()
                    break
                if x == curly:
                    nest.append("{")
                elif x == curled:
                    if not nest:
                        raise ValueError(i)
                    if nest.pop() == "`":
                        p = _TPL_PART.match(text, i)
                        if p is None:
                            raise ValueError(i)
                        if p[1] == "`":
                            out.append(k["TTAIL"])
                        else:
                            out.append(k["TMID"])
                            nest.append("`")
                        i = p.end()
                        break
                    if nest and nest[-1].__class__ is tuple:
                        out.append(x)
                        break
                elif x == round_:
                    parens.append(bool(out) and out[-1] in heads)
                elif x == rounded:
                    out.append(x)
                    after_head = parens.pop() if parens else False
                    continue
                elif x == less and self.elements and not (out and out[-1] in values and not (out[-1] == rounded and after_head)) and _ELEMENT.match(text, i - 1) and not _GENERIC_ARROW.match(text, i - 1):
                    i = self._tag(text, i - 1, out, nest)
                    break
                out.append(x)
                after_head = False
            else:
                if i < n:
                    raise ValueError(i)
        if nest and not all(x == "{" for x in nest):
            raise ValueError(n)
        out.append(0)
        return out, breaks


lex_js, lex_ts, lex_tsx = JsLexer(JS, True), JsLexer(TS, False), JsLexer(TS, True)

# ---------------------------------------------------------------- Python

PYTHON = Grammar(
    """
    File = ( NEWLINE | Stmt )* ;
    Stmt = SimpleLine | Compound ;
    SimpleLine = Small ( ';' Small )* ';'? NEWLINE ;
    Small = ExprStmt | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' ( Test ( 'from' Test )? )? | 'global' Names | 'nonlocal' Names | 'del' Targets | 'assert' Test ( ',' Test )? | Import | 'type' Name TypeParams? '=' Test ;
    Names = Name ( ',' Name )* ;
    Name = ID | 'match' | 'case' | 'type' | '_' ;
    Targets = Target ( ',' Target )* ','? ;
    Target = Primary | '*' Primary ;
    ExprStmt = Stars ( AugOp ( Yield | Stars ) | ( '=' ( Yield | Stars ) )* | ':' Test ( '=' ( Yield | Stars ) )? ) | Yield ;
    AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' ;
    Yield = 'yield' ( 'from' Test | Stars )? ;
    Stars = Star ( ',' Star )* ','? ;
    Star = '*' Or | Named ;
    Named = Name ':=' Test | Test ;
    Import = 'import' DottedAs ( ',' DottedAs )* | 'from' ( ( '.' | '...' )* Dotted | ( '.' | '...' )+ ) 'import' ( '*' | '(' NameAs ( ',' NameAs )* ','? ')' | NameAs ( ',' NameAs )* ) ;
    DottedAs = Dotted ( 'as' Name )? ;
    Dotted = Name ( '.' Name )* ;
    NameAs = Name ( 'as' Name )? ;
    Compound = 'async'? ( Def | With | For ) | If | While | Try | Class | Decorated | Match ;
    Decorated = ( '@' Named NEWLINE )+ ( 'async'? Def | Class ) ;
    Def = 'def' Name TypeParams? '(' Params ')' ( '->' Test )? ':' Suite ;
    TypeParams = '[' TParam ( ',' TParam )* ','? ']' ;
    TParam = ( '*' | '**' )? Name ( ':' Test )? ( '=' Test )? ;
    Params = ( Param ( ',' Param )* ','? )? ;
    Param = Name ( ':' Test )? ( '=' Test )? | '*' ( Name ( ':' Star )? )? | '**' Name ( ':' Test )? | '/' ;
    LParams = ( LParam ( ',' LParam )* ','? )? ;
    LParam = Name ( '=' Test )? | '*' Name? | '**' Name | '/' ;
    Class = 'class' Name TypeParams? ( '(' Args ')' )? ':' Suite ;
    If = 'if' Named ':' Suite ( 'elif' Named ':' Suite )* ( 'else' ':' Suite )? ;
    While = 'while' Named ':' Suite ( 'else' ':' Suite )? ;
    For = 'for' Stars2 'in' Stars ':' Suite ( 'else' ':' Suite )? ;
    Stars2 = Target2 ( ',' Target2 )* ','? ;
    Target2 = '*'? Arith ;
    Try = 'try' ':' Suite ( Except+ ( 'else' ':' Suite )? ( 'finally' ':' Suite )? | 'finally' ':' Suite ) ;
    Except = 'except' '*'? ( Test ( ',' Test )* ( 'as' Name )? )? ':' Suite ;
    With = 'with' ( WithItem ( ',' WithItem )* | '(' WithItem ( ',' WithItem )* ','? ')' ) ':' Suite ;
    WithItem = Test ( 'as' Target )? ;
    Match = 'match' Stars ':' NEWLINE INDENT Case+ DEDENT ;
    Case = 'case' Patterns ( 'if' Named )? ':' Suite ;
    Patterns = PatAs ( ',' PatAs )* ','? ;
    PatAs = PatOr ( 'as' Name )? | '*' Name ;
    PatOr = Pat ( '|' Pat )* ;
    Pat = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | Name ( '.' Name )* ( '(' ( PatArg ( ',' PatArg )* ','? )? ')' )? | '(' Patterns? ')' | '[' Patterns? ']' | '{' ( PatKey ( ',' PatKey )* ','? )? '}' ;
    PatArg = ( Name '=' )? PatAs ;
    PatKey = ( '-'? NUM | STR+ | 'None' | 'True' | 'False' | Name ( '.' Name )+ ) ':' PatAs | '**' Name ;
    Suite = SimpleLine | NEWLINE INDENT Stmt+ DEDENT ;
    Test = Or ( 'if' Or 'else' Test )? | 'lambda' LParams ':' Test ;
    Or = Not ( ( 'or' | 'and' ) Not )* ;
    Not = 'not'* Comp ;
    Comp = Arith ( CompOp Arith )* ;
    CompOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
    Arith = Unary ( ArithOp Unary )* ;
    ArithOp = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' ;
    Unary = ( '+' | '-' | '~' )* 'await'? Primary ;
    Primary = Atom Trailer* ;
    Trailer = '.' Name | '(' Args ')' | '[' Subs ']' ;
    Subs = Sub ( ',' Sub )* ','? ;
    Sub = Star | Test? ':' Test? ( ':' Test? )? ;
    Args = ( Arg ( ',' Arg )* ','? )? ;
    Arg = Named CompFor? | Name '=' Test | '*' Test | '**' Test ;
    CompFor = ( 'async'? 'for' Stars2 'in' Or ( 'if' CondNoElse )* )+ ;
    CondNoElse = Name ':=' Or | Or | 'lambda' LParams ':' Or ;
    Atom = Name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ( Yield | Stars | Named CompFor )? ')' | '[' ( Stars | Named CompFor )? ']' | '{' ( Dict | Stars | Named CompFor | DictItem CompFor )? '}' ;
    Dict = DictItem ( ',' DictItem )* ','? ;
    DictItem = Test ':' Test | '**' Or ;
    """,
    ("File",),
)
_PY_STR = r"(?P<str>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|.))*'|\"\"|''))"
_PY_FSTR = r"(?P<fstr>[rR]?[fFtT][rR]?(?:\"(?!\"\")(?:[^\"\\\n{]|\\.|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})+\})*\"|'(?!'')(?:[^'\\\n{]|\\.|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})+\})*'))"
_PY_RE = re.compile(
    rf"(?P<w>[ \t\f]+|\#[^\n]*|\\\r?\n)|(?P<n>\r?\n|\r)|{_PY_FSTR}|{_PY_STR}|(?P<i>{_ID})|(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?!\w))"
    r"|(?P<o>\.\.\.|\*\*=|//=|<<=|>>=|->|:=|\*\*|//|<<|>>|[-+*/%@&|^=!<>]=|[-+*/%@&|^~=<>.,;:(){}\[\]])",
    re.S,
)
_PY_WORDS = {w: PYTHON.kinds[w] for w in "pass break continue return raise from global nonlocal del assert import as type match case _ async def with for in if elif else while try except finally class yield await lambda or and not is None True False".split() if w in PYTHON.kinds}


def lex_python(text: str):
    """Adds NEWLINE, INDENT and DEDENT; blank lines and lines inside brackets have none. Tabs go to multiples of 8."""
    k = PYTHON.kinds
    new, ind, ded, ident = k["NEWLINE"], k["INDENT"], k["DEDENT"], k["ID"]
    out, stack, depth, i, n, start = [], [0], [], 0, len(text), True
    pair = {")": "(", "]": "[", "}": "{"}
    match = _PY_RE.match
    while i < n:
        if start and not depth:
            j, col = i, 0
            while j < n and text[j] in " \t\f":
                col = (col // 8 + 1) * 8 if text[j] == "\t" else 0 if text[j] == "\f" else col + 1
                j += 1
            if j >= n:
                break
            if text[j] in "\r\n#":
                e = text.find("\n", j)
                if e < 0:
                    break
                i = e + 1
                continue
            if col > stack[-1]:
                stack.append(col)
                out.append(ind)
            while col < stack[-1]:
                stack.pop()
                out.append(ded)
            if col != stack[-1]:
                raise ValueError(j)
            start, i = False, j
        m = match(text, i)
        if m is None:
            raise ValueError(i)
        g = m.lastgroup
        i = m.end()
        if g == "w":
            continue
        if g == "n":
            if not depth:
                out.append(new)
                start = True
            continue
        if g == "i":
            out.append(_PY_WORDS.get(m[0], ident))
        elif g == "num":
            out.append(k["NUM"])
        elif g == "o":
            t = m[0]
            if t in "([{":
                depth.append(t)
            elif t in pair:
                if not depth or depth.pop() != pair[t]:
                    raise ValueError(i)
            q = k.get(t)
            if q is None:
                raise ValueError(i)
            out.append(q)
        else:
            out.append(k["STR"])
    if depth:
        raise ValueError(n)
    if out and out[-1] not in (new, ded):
        out.append(new)
    out += [ded] * (len(stack) - 1)
    out.append(0)
    return out, frozenset()


# Words that Python up to 3.6 reads as names.
_PY_NAMES = dict.fromkeys((PYTHON.kinds["async"], PYTHON.kinds["await"]), PYTHON.kinds["ID"])


def lex_python36(text: str):
    return [_PY_NAMES.get(k, k) for k in lex_python(text)[0]], frozenset()


# ---------------------------------------------------------------- shell

_SHELL_RULES = """
    List = AndOr ( Sep AndOr )* Sep? ;
    Sep = ( ';' | '&' ) NL* | NL+ ;
    AndOr = Pipe ( ( '&&' | '||' ) NL* Pipe )* ;
    Prefix = ASSIGN | Redir ;
    Simple = Prefix+ ( CmdWord Arg* )? | CmdWord Arg* ;
    Redir = REDIR Word | REDIR ASSIGN | HERE ;
    If = 'if' NL* List 'then' NL* List ( 'elif' NL* List 'then' NL* List )* ( 'else' NL* List )? 'fi' ;
    While = ( 'while' | 'until' ) NL* List Do ;
    Case = 'case' ( Word | ASSIGN ) NL* 'in' NL* ( CaseItem ( CaseEnd NL* CaseItem )* ( CaseEnd NL* )? )? 'esac' ;
    CaseItem = '('? PatWord ( '|' PatWord )* ')' NL* List? ;
    Word = WORD | 'if' | 'then' | 'elif' | 'else' | 'fi' | 'for' | 'while' | 'until' | 'do' | 'done' | 'case' | 'esac' | 'in' | 'function' | 'select' | 'time' | '{' | '}' | '!' | '[[' | COND2 ;
    PatWord = WORD | ASSIGN | 'if' | 'then' | 'else' | 'fi' | 'for' | 'while' | 'do' | 'done' | 'case' | 'in' | 'function' | 'select' | 'time' | '{' | '}' | '!' ;
"""
_BASH_RULES = """
    Bash = NL* List? ;
    Pipe = ( '!' | 'time' )* Command ( ( '|' | '|&' ) NL* Command )* | '!' ;
    Command = Simple | Compound Redir* | Def ;
    Prefix = Array ;
    Array = ARRAY '(' ( Word | ASSIGN | Array | NL )* ')' ;
    CmdWord = WORD | BWORD | 'in' | COND2 ;
    Arg = Word | ASSIGN | Array | Redir ;
    Word = BWORD ;
    Redir = BREDIR Word | BREDIR ASSIGN ;
    Def = ( WORD | BWORD ) '(' ')' NL* Compound Redir* | 'function' Word ( '(' ')' )? NL* Compound Redir* ;
    Compound = '{' NL* List '}' | '(' NL* List ')' | ARITH | Cond | If | For | While | Case | 'select' WORD ( NL* 'in' Word* )? Sep Do ;
    Cond = '[[' CondPart+ COND2 ;
    CondPart = Word | ASSIGN | '&&' | '||' | '(' | ')' | REDIR | NL ;
    For = 'for' WORD ( NL* 'in' ( Word | ASSIGN )* )? Sep? Do | 'for' ARITH Sep? Do ;
    Do = 'do' NL* List 'done' | '{' NL* List '}' ;
    CaseEnd = ';;' | ';&' | ';;&' ;
    PatWord = BWORD ;
"""
_POSIX_RULES = """
    Posix = NL* List? ;
    Pipe = '!'? Command ( '|' NL* Command )* ;
    Command = Simple | Compound Redir* | Def ;
    CmdWord = WORD | 'in' | COND2 | '[[' | 'function' | 'select' | 'time' ;
    Arg = Word | ASSIGN | Redir ;
    Def = ( WORD | 'function' | 'select' | 'time' ) '(' ')' NL* Compound Redir* ;
    Compound = '{' NL* List '}' | '(' NL* List ')' | If | For | While | Case ;
    For = 'for' WORD ( NL* 'in' ( Word | ASSIGN )* )? Sep? Do ;
    Do = 'do' NL* List 'done' ;
    CaseEnd = ';;' ;
"""


def _named(rules: str, tag: str) -> str:
    """The same rules under names of their own, so that two dialects stand in one grammar."""
    return re.sub(r"('[^']*')|\b([A-Z][a-z]\w*)\b", lambda m: m[1] or (m[2] if m[2] in ("Bash", "Posix") else m[2] + tag), rules)


SHELL = Grammar(_named(_SHELL_RULES + _BASH_RULES, "B") + _named(_SHELL_RULES + _POSIX_RULES, "P"), ("Bash", "Posix"), balanced=False)
_SH_KEYS = {w: SHELL.kinds[w] for w in "if then elif else fi for while until do done case esac in function select time { } ! [[".split()} | {"]]": SHELL.kinds["COND2"]}
_SH_BLANK = re.compile(r"(?:[ \t\r]|\\\r?\n)+")
_SH_REDIR = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|>>|>\||<&|>&|&>>|&>|<|>)")
_SH_OPS = re.compile(r";;&|;;|;&|&&|\|\||\|&|[;&|()\n]")
_SH_PLAIN = re.compile(r"[^\s\"'\\$`;&|()<>\n]+")
_SH_ASSIGN = re.compile(r"\w+(?:\[[^\]]*\])?\+?=")
_SH_QUOTED = re.compile(r"[^\"\\$`]+")
_SH_BRACED = re.compile(r"[^}\\\"'$`]+")
_SH_ROUND = re.compile(r"[^()\\\"'$`]+")
_SH_ANSI = re.compile(r"\$'(?:[^'\\]|\\.)*'", re.S)
_SH_BACK = re.compile(r"`((?:[^`\\]|\\.)*)`", re.S)
#: tokens after which a command may begin, so that `case` is a word of the language there
_SH_BEFORE = {SHELL.kinds[x] for x in (";", "&", "&&", "||", "|", "|&", "(", ")", "NL", "{", "then", "do", "else", "elif", "if", "while", "until", "!", "time", ";;", ";&", ";;&")}


class _Text:
    """One list of commands: the whole text or what a substitution holds; `marks` are its open brackets and cases."""

    __slots__ = ("out", "marks", "heres", "slot", "start", "arrays", "inner")

    def __init__(self):
        self.out, self.marks, self.heres, self.slot, self.start, self.arrays, self.inner = [], [], [], -1, 0, False, []


class _Shell:
    """The token lists of a shell text: its own and one per substitution in it.

    One pass with a stack of what is open (a list of commands, a word, a quoted or braced part, arithmetic), so depth
    costs nothing. `$((` is read as arithmetic and, should its brackets not close together, read again as a substitution;
    such places are remembered, and so is every substitution that was read to its end, so nothing is read more than twice.
    """

    def __init__(self, text: str):
        self.t, self.plain, self.done, self.here_at = text, set(), {}, None
        self.open_texts: list[_Text] = [_Text()]

    def lines(self) -> dict[str, list[int]]:
        """Line -> where it begins, for ends of here-documents."""
        if self.here_at is None:
            self.here_at, at = {}, 0
            for x in self.t.split("\n"):
                self.here_at.setdefault(x.rstrip("\r"), []).append(at)
                at += len(x) + 1
            self.tabbed = {}
            for x, where in self.here_at.items():
                self.tabbed.setdefault(x.lstrip("\t"), []).extend(where)
            for where in self.tabbed.values():
                where.sort()
        return self.here_at

    def run(self) -> list[list[int]]:
        t, n, i = self.t, len(self.t), 0
        # what is open: ("text", _Text, where it began), ("word", _Text), ("quoted",), ("braced", in quotes), ("round", where it began, depth, arithmetic, substitutions so far)
        stack: list[list] = [["text", self.open_texts[0], -1]]
        while True:
            top = stack[-1]
            what = top[0]
            if what == "text":
                i = self.text(i, stack)
                if i < 0:
                    lists, todo = [], [top[1]]
                    while todo:
                        x = todo.pop()
                        lists.append(x.out)
                        todo += x.inner
                    return lists
                continue
            if i >= n:
                if what == "word":
                    stack.pop()
                    self.word_ends(top[1], n)
                    continue
                i = self.unclosed(stack)
                continue
            c = t[i]
            if c == "\\":
                i += 2
            elif c == "$":
                i = self.dollar(i, stack)
            elif c == "`":
                m = _SH_BACK.match(t, i)
                if m is None:
                    raise ValueError(i)
                for out in _Shell(re.sub(r"\\([`\\$])", r"\1", m[1])).run():
                    held = _Text()
                    held.out = out
                    self.open_texts[-1].inner.append(held)
                i = m.end()
            elif what == "quoted":
                if c == '"':
                    stack.pop()
                    i += 1
                else:
                    i = _SH_QUOTED.match(t, i).end()
            elif c == '"':
                stack.append(["quoted"])
                i += 1
            elif what == "braced":
                if c == "}":
                    stack.pop()
                    i += 1
                elif c == "'":
                    k = -1 if top[1] else t.find("'", i + 1)
                    i = k + 1 if k >= 0 else i + 1
                else:
                    i = _SH_BRACED.match(t, i).end()
            elif c == "'":
                k = t.find("'", i + 1)
                if k < 0:
                    raise ValueError(n)
                i = k + 1
            elif what == "round":
                if c == "(":
                    top[2] += 1
                    i += 1
                elif c == ")":
                    top[2] -= 1
                    i += 1
                    if top[2] == 1 and top[3] and not t.startswith(")", i):
                        i = self.again(stack, top)
                    elif not top[2]:
                        stack.pop()
                        if top[3] and stack[-1][0] == "text":
                            stack[-1][1].out.append(SHELL.kinds["ARITH"])
                else:
                    i = _SH_ROUND.match(t, i).end()
            else:  # a word
                m = _SH_PLAIN.match(t, i)
                if m:
                    i = m.end()
                elif c in "<>" and t.startswith("(", i + 1):
                    top[1].arrays = True
                    i = self.open(i, i + 2, stack)
                elif c == "(" and i > top[1].start and t[i - 1] in "@?*+!":
                    top[1].arrays = True
                    stack.append(["round", i, 1, False, 0])
                    i += 1
                else:
                    stack.pop()
                    self.word_ends(top[1], i)

    def again(self, stack: list, at: list) -> int:
        """Goes back to a `((` or `$((` that isn't arithmetic."""
        while True:
            f = stack.pop()
            if f[0] == "text":
                self.open_texts.pop()
            if f is at:
                break
        del self.open_texts[-1].inner[at[4] :]
        self.plain.add(at[1])
        return at[1]

    def unclosed(self, stack: list) -> int:
        """At the end of the text: whatever is open as arithmetic isn't any, however it is reached."""
        rounds = [f for f in stack if f[0] == "round" and f[3]]
        if not rounds:
            raise ValueError(len(self.t))
        self.plain.update(f[1] for f in rounds)
        return self.again(stack, rounds[0])

    def open(self, at: int, inside: int, stack: list) -> int:
        """Begins the commands of a substitution; one that was read before is skipped."""
        known = self.done.get(at)
        if known is not None:
            self.open_texts[-1].inner.append(known[1])
            return known[0]
        self.open_texts.append(_Text())
        stack.append(["text", self.open_texts[-1], at])
        return inside

    def dollar(self, i: int, stack: list) -> int:
        t = self.t
        if t.startswith("$((", i) and i not in self.plain:
            stack.append(["round", i, 2, True, len(self.open_texts[-1].inner)])
            return i + 3
        if t.startswith("$(", i):
            return self.open(i, i + 2, stack)
        if t.startswith("${", i):
            stack.append(["braced", any(f[0] == "quoted" for f in stack[-1:])])
            return i + 2
        if t.startswith("$'", i) and stack[-1][0] != "quoted":
            m = _SH_ANSI.match(t, i)
            if m is None:
                raise ValueError(i)
            return m.end()
        return i + 1

    def word_ends(self, text: _Text, i: int) -> None:
        k, w = SHELL.kinds, self.t[text.start : i]
        out = text.out
        if text.slot == -2:  # the word of a here-document
            if i == text.start:
                raise ValueError(i)
            end, tabs = re.sub(r"[\"'\\]", "", w), text.heres.pop()
            text.heres.append((end, tabs))
            out.append(k["HERE"])
            text.arrays = False
            return
        if i <= text.start:
            raise ValueError(i)
        a = _SH_ASSIGN.match(w)
        if a and a.end() == len(w) and self.t.startswith("(", i):
            out.append(k["ARRAY"])
        elif a:
            out.append(k["ASSIGN"])
        else:
            x = k["BWORD"] if text.arrays else _SH_KEYS.get(w, k["WORD"])
            if x == k["case"] and (not out or out[-1] in _SH_BEFORE):
                text.marks.append("case")
            elif x == k["esac"] and text.marks and text.marks[-1] == "case" and out[-1] in _SH_ESAC:
                text.marks.pop()
            out.append(x)
        text.arrays = False

    def text(self, i: int, stack: list) -> int:
        """Goes on in a list of commands up to its next word or its end; -1 at the end of everything."""
        t, k, n = self.t, SHELL.kinds, len(self.t)
        _, text, began = stack[-1]
        out = text.out
        while i < n:
            m = _SH_BLANK.match(t, i)
            if m:
                i = m.end()
                continue
            c = t[i]
            if c == "#":
                i = t.find("\n", i)
                if i < 0:
                    i = n
                continue
            if c == "(" and t.startswith("((", i) and i not in self.plain and (not out or out[-1] not in (k["WORD"], k["ARRAY"])):
                stack.append(["round", i, 2, True, len(self.open_texts[-1].inner)])
                return i + 2
            m = _SH_REDIR.match(t, i)
            if m and not (c in "<>" and t.startswith("(", i + 1)):
                i = m.end()
                op = m[0].lstrip("0123456789")
                if op in ("<<", "<<-") or op[-3:] == "}<<" or op[-4:] == "}<<-":
                    b = _SH_BLANK.match(t, i)
                    i = b.end() if b else i
                    text.heres.append(op.endswith("-"))
                    text.slot, text.start = -2, i
                    stack.append(["word", text])
                    return i
                out.append(k["BREDIR"] if op[0] == "{" or op in ("<<<", "&>", "&>>") else k["REDIR"])
                continue
            m = _SH_OPS.match(t, i)
            if m is None:
                text.slot, text.start = 0, i
                stack.append(["word", text])
                return i
            if c == ")":
                if text.marks and text.marks[-1] == "(":
                    text.marks.pop()
                elif not text.marks and began >= 0:
                    if text.heres:
                        raise ValueError(i)
                    out.append(0)
                    stack.pop()
                    self.open_texts.pop()
                    self.open_texts[-1].inner.append(text)
                    self.done[began] = (i + 1, text)
                    return i + 1
                out.append(k[")"])
                i += 1
                continue
            if c == "(":
                text.marks.append("(")
            i = m.end()
            if c != "\n":
                out.append(k[m[0]])
                continue
            out.append(k["NL"])
            for end, tabs in text.heres:
                self.lines()
                where = (self.tabbed if tabs else self.here_at).get(end, ())
                j = bisect_left(where, i)
                if j == len(where):
                    raise ValueError(n)
                e = t.find("\n", where[j])
                i = e + 1 if e >= 0 else n
            text.heres = []
        if began >= 0:
            return self.unclosed(stack)
        if text.heres:
            raise ValueError(n)
        out.append(0)
        return -1


_SH_ESAC = _SH_BEFORE | {SHELL.kinds["in"]}


def lex_shell(text: str) -> list[list[int]]:
    return _Shell(text).run()


def shell_dialects(lists: list[list[int]]) -> tuple[set[str], int, int]:
    """The dialects that derive the text and everything substituted in it; lists that look alike are parsed once."""
    found, done = {"Bash", "Posix"}, set()
    for kinds in lists:
        key = tuple(kinds)
        if key in done:
            continue
        done.add(key)
        got, far = SHELL.accepts(kinds)
        found &= got
        if not found:
            return found, far, len(kinds) - 1
    return found, 0, 0

#: language -> groups of dialects (lexer, grammar); a group whose lexer or grammar differs is asked where those before it reject
PARSERS = {
    "go": ((lex_go, GO),), "rust": ((lex_rust, RUST), (lex_rust_2015, RUST_2015)), "java": ((lex_java, JAVA), (lex_old_java, JAVA)), "c": ((lex_c, C),), "header": ((lex_c, C), (lex_cpp, CPP)), "cpp": ((lex_cpp, CPP),),
    "javascript": ((lex_js, JS),), "typescript": ((lex_ts, TS),), "tsx": ((lex_tsx, TS),), "python": ((lex_python, PYTHON), (lex_python36, PYTHON)), "bash": ((lex_shell, SHELL),),
}

# File extension -> language; `header` is C or C++, `tsx` TypeScript with elements.
EXTENSIONS = {
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "header", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "pyi": "python", "sh": "bash", "bash": "bash",
}
#: the language a set of dialects is reported as, where it has another name
REPORTED = {"header": "c", "tsx": "typescript"}


def parse(content: bytes, language: str) -> tuple[bool, str]:
    """(valid, why not). Valid if some dialect of the language derives the whole text. Nothing but blanks is valid.

    A byte order mark is skipped. Bytes that are no UTF-8 are read as Latin-1, so they may stand in strings and comments.
    Neither the length of a text nor how deeply it nests changes the verdict.
    """
    if content.startswith(b"\xef\xbb\xbf"):
        content = content[3:]
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    if not text.strip():
        return True, ""
    text = text.replace("\r\n", "\n")
    why = ""
    for lexer, grammar in PARSERS[language]:
        try:
            if grammar is SHELL:
                found, far, n = shell_dialects(lexer(text))
            else:
                toks, breaks = lexer(text)
                n = len(toks) - 1
                found, far = grammar.accepts(toks, breaks)
            if found and grammar in (C, CPP):
                at = c_arm_without_derivation(text, _C_LEX if grammar is C else _CPP_LEX, grammar)
                if at is not None:
                    why = why or f"no derivation has the arm at character {at}"
                    continue
        except ValueError as e:
            why = why or f"no token at {e}"
            continue
        if found:
            return True, ""
        why = why or f"no dialect goes beyond token {far} of {n}"
    return False, why
