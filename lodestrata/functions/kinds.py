"""Classification of syntax node kinds and languages, as literal maps that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol class by node kind.
SYMBOL_CLASS = {
    "function": ("function_declaration", "function_item", "function_definition"),
    "method": ("method_declaration", "method_item"),
    "type": ("type_declaration", "struct_item", "enum_item", "trait_item", "type_spec"),
    "variable": ("var_declaration", "let_declaration", "short_var_declaration"),
    "constant": ("const_declaration", "const_spec", "const_item"),
}
# Semantic tag by node kind (function 1, method 2, type 3, import 4, other 0).
SEMANTIC_TAG = {
    1: ("function_declaration", "function_definition", "function_item"),
    2: ("method_declaration", "method_definition", "method_signature_item"),
    3: ("struct_item", "type_declaration", "type_alias", "type_alias_declaration", "type_alias_statement", "class_declaration", "class_definition", "interface_declaration", "enum_declaration", "enum_item", "trait_item", "impl_item"),
    4: ("import_declaration", "import_statement", "import_spec", "import_from_statement", "use_declaration"),
}
# Kinds that are parameters in every language.
PARAMETERS = ("parameter", "parameters", "parameter_declaration", "typed_parameter")
# Canonical kind by language and raw kind.
CANONICAL = {
    "go": {
        "function": ("function_declaration",), "method": ("method_declaration",), "type": ("type_declaration", "type_spec", "struct_type", "interface_type"), "field": ("field_declaration",),
        "constant": ("const_declaration", "const_spec"), "variable": ("var_declaration", "var_spec", "short_var_declaration"), "import": ("import_declaration", "import_spec"), "module": ("source_file",),
    },
    "rust": {
        "function": ("function_item", "function_signature_item"), "type": ("struct_item", "enum_item", "trait_item", "type_item", "union_item"), "field": ("field_declaration",),
        "constant": ("const_item", "static_item"), "variable": ("let_declaration",), "import": ("use_declaration",), "module": ("mod_item", "source_file"),
    },
    "python": {"function": ("function_definition",), "type": ("class_definition",), "import": ("import_statement", "import_from_statement"), "module": ("module",)},
    "javascript": {"function": ("function_declaration", "function_expression", "arrow_function"), "method": ("method_definition",), "type": ("class_declaration", "class"), "import": ("import_statement",), "module": ("program",)},
    "typescript": {
        "function": ("function_declaration", "function_expression", "arrow_function", "function_signature"), "method": ("method_definition", "method_signature"),
        "type": ("class_declaration", "abstract_class_declaration", "class", "interface_declaration", "type_alias_declaration", "enum_declaration"), "import": ("import_statement",), "module": ("program",),
    },
    "java": {"method": ("method_declaration",), "type": ("class_declaration", "interface_declaration", "enum_declaration", "record_declaration"), "import": ("import_declaration",), "module": ("program",)},
    "c": {"function": ("function_definition", "function_declarator"), "type": ("struct_specifier", "union_specifier", "enum_specifier", "type_definition"), "field": ("field_declaration",), "import": ("preproc_include",), "module": ("translation_unit",)},
    "cpp": {
        "function": ("function_definition", "function_declarator"), "type": ("struct_specifier", "union_specifier", "enum_specifier", "type_definition", "class_specifier"), "field": ("field_declaration",),
        "import": ("preproc_include",), "module": ("namespace_definition", "translation_unit"),
    },
    "sql": {"type": ("create_table", "create_view", "create_materialized_view"), "function": ("create_function",), "module": ("create_schema", "program")},
    "bash": {"function": ("function_definition",), "module": ("program",)},
}
# Language by file extension.
LANGUAGE_OF = {"go": "go", "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "sql": "sql", "sh": "bash", "bash": "bash", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "hcl": "hcl"}


def _chain(col: Column, table: dict, other) -> Column:
    out = None
    for value, kinds in table.items():
        cond = col.isin(*kinds)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(other))


def symbol_class(kind: Column) -> Column:
    return _chain(kind, SYMBOL_CLASS, "unknown")


def semantic_tag(kind: Column) -> Column:
    return _chain(kind, SEMANTIC_TAG, 0)


def language_of(path: Column) -> Column:
    """Language by extension (or a few whole file names); NULL where unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_name = F.when(F.regexp_extract(path, r"([^/]+)$", 1).isin("Dockerfile", "Makefile"), F.lit("make"))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[ext], by_name)


def canonical_kind(language: Column, kind: Column) -> Column:
    """Canonical kind of a raw kind in a language; NULL where the language has none for it."""
    flat = {f"{lang}:{raw}": k for lang, t in CANONICAL.items() for k, raws in t.items() for raw in raws}
    own = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])[F.concat(language, F.lit(":"), kind)]
    return F.when(kind.isin(*PARAMETERS), F.lit("parameter")).otherwise(own)


def bucket_arity(n: Column) -> Column:
    """Six buckets of a child count: 0, 1, 2, 3-4, 5-7, 8 and more."""
    return F.when(n <= 2, n).when(n <= 4, 3).when(n <= 7, 4).otherwise(5).cast("int")
