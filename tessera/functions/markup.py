"""Entities of JavaScript, TypeScript, SQL, Markdown, YAML and JSON texts, by patterns inside the JVM.

Each function maps a text column to an array of structs; `rows` explodes them to one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        ("function", r"(?m)\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("),
        ("arrow", r"(?m)\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"),
        ("class", r"(?m)\bclass\s+([A-Za-z_$][\w$]*)"),
        ("import", r"""(?m)^\s*import\b[^'"\n]*['"]([^'"]+)['"]"""),
        ("export", r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_$][\w$]*)"),
        ("variable", r"(?m)\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
    ],
    "typescript": [
        ("interface", r"(?m)\binterface\s+([A-Za-z_$][\w$]*)"),
        ("type", r"(?m)^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)(?:<[^>]*>)?\s*="),
        ("enum", r"(?m)\benum\s+([A-Za-z_$][\w$]*)"),
    ],
    "sql": [
        ("table", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)"),
        ("view", r"(?i)\bcreate\s+(?:or\s+replace\s+)?view\s+[`\"\[]?([\w.]+)"),
        ("index", r"(?i)\bcreate\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)"),
        ("procedure", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:procedure|function)\s+[`\"\[]?([\w.]+)"),
        ("trigger", r"(?i)\bcreate\s+(?:or\s+replace\s+)?trigger\s+[`\"\[]?([\w.]+)"),
        ("read", r"(?i)\b(?:from|join)\s+[`\"\[]?([A-Za-z_][\w.]*)"),
        ("write", r"(?i)\b(?:insert\s+into|update|delete\s+from)\s+[`\"\[]?([A-Za-z_][\w.]*)"),
        ("foreign_key", r"(?i)\breferences\s+[`\"\[]?([\w.]+)"),
    ],
    "markdown": [
        ("heading", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*$"),
        ("link", r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)"),
        ("image", r"!\[[^\]\n]*\]\(([^)\s]+)"),
        ("code_block", r"(?ms)^```([\w+-]*)[^\n]*\n.*?^```"),
        ("list_item", r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+(.+)$"),
        ("quote", r"(?m)^>[ \t]?(.*)$"),
        ("table_row", r"(?m)^\|(.+)\|[ \t]*$"),
    ],
    "yaml": [
        ("key", r"(?m)^[ \t-]*([A-Za-z_][\w.-]*)[ \t]*:(?:[ \t]|$)"),
        ("anchor", r"&([A-Za-z_][\w-]*)"),
        ("alias", r"(?<=[ \t])\*([A-Za-z_][\w-]*)"),
        ("env", r"\$\{?([A-Z_][A-Z0-9_]*)"),
        ("document", r"(?m)^(---)[ \t]*$"),
    ],
    "json": [("key", r'"((?:[^"\\]|\\.)*)"\s*:')],
}
PATTERNS["typescript"] += PATTERNS["javascript"]

#: Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".sql": "sql", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}


def language(extension: Column) -> Column:
    out = F.lit("unknown")
    for ext, name in LANGUAGES.items():
        out = F.when(extension == ext, name).otherwise(out)
    return out


def found(text: Column, lang: str) -> Column:
    """array of (kind, name) of a text."""

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    return F.concat(*[named(k, p) for k, p in PATTERNS[lang]])


def rows(files: DataFrame, lang: str, path: str = "path", text: str = "text") -> DataFrame:
    """path, kind, name."""
    return files.select(path, F.explode(found(F.col(text), lang)).alias("e")).select(path, "e.kind", "e.name")


def json_facts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, valid, n_keys, schema: the schema as Spark reads it from the VARIANT value."""
    parsed = files.select(path, F.col(text).alias("_t"), F.try_parse_json(text).alias("v"))
    return parsed.select(path, F.col("v").isNotNull().alias("valid"), F.size(F.regexp_extract_all("_t", F.lit(PATTERNS["json"][0][1]), F.lit(1))).alias("n_keys"), F.schema_of_variant("v").alias("schema"))


def js_complexity(text: Column) -> Column:
    """1 + branches, short circuits and conditionals."""
    return 1 + F.regexp_count(text, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])"))
