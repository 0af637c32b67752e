"""Column functions over paths, names, source text and numbers; all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_PARTS = ("__pycache__", ".git", "node_modules", "venv", ".venv", "dist", "build")
ARCHIVE = r"(?i)\.(zip|tar|tar\.gz|tgz|tar\.bz2)$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty if none. A leading dot is no extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def depth(path: Column) -> Column:
    """Parts of the path; the root of an absolute path counts as one."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")) + F.when(path.startswith("/"), 1).otherwise(0)


def is_archive(path: Column) -> Column:
    return path.rlike(ARCHIVE)


def is_ignored(path: Column, parts: Iterable[str] = IGNORED_PARTS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, parts)))


def matches_any(path: Column, needles: Iterable[str]) -> Column:
    """Whether one of the given strings is part of the path, in any case."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(F.lower(path), F.lit(n.lower()))
    return out


def split_name(name: Column) -> Column:
    """Lower-case parts of a snake_case, camelCase or PascalCase name."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1)), F.lower)


def snake_case(name: Column) -> Column:
    return F.array_join(split_name(name), "_")


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(split_name(name), F.initcap), "")


def tokens(text: Column, least: int = 2, stop: Iterable[str] = ()) -> Column:
    """ASCII words of at least `least` letters, lower-cased, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![A-Za-z0-9_])([a-z]{{{least},}})(?![A-Za-z0-9_])"), F.lit(1))
    words = list(stop)
    return F.filter(found, lambda x: ~x.isin(words)) if words else found


def line_counts(text: Column, comment: str = "#") -> dict[str, Column]:
    """total, blank, comment and code lines, by each line's first characters."""
    lines = F.transform(F.split(text, "\n", -1), F.trim)
    total, blank = F.size(lines), F.size(F.filter(lines, lambda x: x == ""))
    comments = F.size(F.filter(lines, lambda x: x.startswith(comment)))
    return {"total": total, "blank": blank, "comments": comments, "code": total - blank - comments}


def occurrences(text: Column, needle: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)


def band(value: Column, bounds: Iterable[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound, from above, that the value reaches."""
    out = F.lit(otherwise)
    for least, label in sorted(bounds):
        out = F.when(value >= least, label).otherwise(out)
    return out


#: Levels of affinity.
AFFINITY_LEVELS = ((1.0, "identical"), (0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low"))


def affinity_level(value: Column) -> Column:
    return band(value, AFFINITY_LEVELS, "minimal")


#: Risk of a cyclomatic complexity.
RISK_LEVELS = ((21, "very_high"), (11, "high"), (6, "moderate"))


def risk_level(complexity: Column) -> Column:
    return band(complexity, RISK_LEVELS, "low")


def maintainability(loc: Column, complexity: Column, comment_ratio: Column) -> Column:
    """Maintainability index, 0 to 100: volume stands for loc * log2(loc + 1)."""
    volume = loc * F.log2(loc + 1)
    raw = 171 - 5.2 * F.log(volume + 1) - 0.23 * complexity - 16.2 * F.log(loc + 1) + 50 * comment_ratio
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)), 2)


def complexity_score(functions: Column, classes: Column, flows: Column, imports: Column) -> Column:
    return functions + 2 * classes + 0.1 * flows + 0.5 * imports


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def mean_of(*columns: Column) -> Column:
    """Mean of the non-null columns; null if all are."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / n)
