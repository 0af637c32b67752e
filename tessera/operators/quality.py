"""Quality figures of files and what follows from them: indices, scores, hotspots, suggestions, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the maintainability buckets, points that a suggestion of each severity costs.
BUCKETS = ((80, "excellent"), (60, "good"), (40, "moderate"), (20, "poor"))
COSTS = {"high": 5.0, "medium": 2.0, "low": 0.5}
RANKS = {"high": 0, "medium": 1, "low": 2}
#: Numbers that need no name, names that a variable may have without being read.
PLAIN_NUMBERS = (100, 1000, 1024)
KNOWN_VARIABLES = ("app", "config", "settings", "logger")


def _case(c: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def maintainability(loc: Column, mean_complexity: Column, functions: Column, docstrings: Column, hints: Column, handles_errors: Column, tests: Column) -> Column:
    """Index of 0 to 100 with points for documentation, type hints, error handling and tests."""
    raw = 171 - 0.23 * F.greatest(mean_complexity, F.lit(1.0)) * functions - 16.2 * F.log(F.greatest(loc, F.lit(1)))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    bonus = F.when(docstrings > 0.8, 5).otherwise(0) + F.when(hints > 0.5, 5).otherwise(0) + F.when(handles_errors, 2).otherwise(0) + F.when(tests, 5).otherwise(0)
    return F.round(F.least(F.lit(100.0), raw + bonus), 2)


def quality_score(docs: Column, types: Column, structure: Column, testing: Column, errors: Column, index: Column) -> Column:
    """Six scores of 0 to 100, weighted by 25, 15, 25, 15, 10 and 10 per cent."""
    return F.round(0.25 * docs + 0.15 * F.least(types, F.lit(100.0)) + 0.25 * F.greatest(F.lit(0.0), structure) + 0.15 * testing + 0.1 * F.least(errors, F.lit(100.0)) + 0.1 * index, 2)


def documentation(module_docstring: Column, docstrings: Column, comment_ratio: Column) -> Column:
    return F.when(module_docstring, 30).otherwise(0) + 50 * docstrings + F.least(100 * comment_ratio, F.lit(20.0))


def structure(smells: Column, mean_complexity: Column, longest: Column) -> Column:
    return 100 - 10 * smells - F.greatest(5 * (mean_complexity - 5), F.lit(0.0)) - F.when(longest > 100, 20).otherwise(0)


def testing(tests: Column, testable: Column) -> Column:
    return F.when(tests, 50).otherwise(0) + F.least(5 * testable, F.lit(50))


def master_factor(score: Column, weight: float = 0.2) -> Column:
    return score / 100 * weight


def bucket(index: Column) -> Column:
    out = F.lit("critical")
    for bound, name in reversed(BUCKETS):
        out = F.when(index >= bound, name).otherwise(out)
    return out


def buckets(files: DataFrame, index: str) -> DataFrame:
    """bucket, n, mean index."""
    return files.groupBy(bucket(F.col(index)).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(index), 4).alias("mean_index"))


def hotspots(functions: DataFrame, complexity: str, key: list[str], n: int = 10) -> DataFrame:
    """The n functions of the highest complexity."""
    return functions.orderBy(F.desc(complexity), *key).limit(n)


def suggestion_counts(suggestions: DataFrame) -> DataFrame:
    """rule, severity, n."""
    return suggestions.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def refactoring_score(suggestions: DataFrame, files: DataFrame, file: str, lines: str) -> DataFrame:
    """file, score: 100 less the costs of its suggestions; long files are forgiven up to two fifths; empty ones have 100."""
    cost = suggestions.groupBy(file).agg(F.sum(_case(F.col("severity"), COSTS, 0.5)).alias("_cost"))
    factor = F.least(F.col(lines) / 100, F.lit(5.0))
    base = 100 - F.coalesce("_cost", F.lit(0.0))
    score = F.when(factor > 1, base * (1 + (factor - 1) * 0.1)).otherwise(base)
    score = F.when(F.col(lines) == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return files.join(cost, file, "left").select(file, F.round(score, 4).alias("score"))


def priorities(suggestions: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """The first n suggestions by severity, then impact."""
    return suggestions.orderBy(_case(F.col("severity"), RANKS, 9), _case(F.col("impact"), RANKS, 9), *key).limit(n)


def quick_wins(suggestions: DataFrame) -> DataFrame:
    """Suggestions of little effort and some impact."""
    return suggestions.filter((F.col("effort") == "low") & F.col("impact").isin("medium", "high"))


def savings(dead: DataFrame, file: str, lines: Column) -> DataFrame:
    """file, n_dead, lines saved by removing the dead definitions."""
    return dead.groupBy(file).agg(F.count("*").alias("n_dead"), F.sum(lines).alias("lines_saved"))


def dead_variables(variables: DataFrame, reads: DataFrame) -> DataFrame:
    """path, name, confidence: module variables that their file never reads; constants, dunder and well-known names
    aside. (Reads are loads alone: the assignment itself is none.)"""
    known = F.col("name").rlike("^[A-Z0-9_]+$") | F.col("name").rlike("^__.*__$") | F.lower("name").isin(*KNOWN_VARIABLES)
    used = reads.select(F.col("path").alias("_p"), F.col("name").alias("_n")).distinct()
    dead = variables.filter(~known).join(used, (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_n")), "left_anti")
    return dead.select("path", "name", F.lit(0.8).alias("confidence"))


def is_magic(value: Column, name: Column) -> Column:
    """Whether a whole number is over ten and given to a name which is no constant."""
    return (value > 10) & ~value.isin(*PLAIN_NUMBERS) & ~name.rlike("^[A-Z0-9_]+$")


def magic_numbers(assignments: DataFrame, value: str) -> DataFrame:
    """The assignments of whole numbers that want a name."""
    return assignments.filter(is_magic(F.col(value), F.col("name")))


def clone_statistics(links: DataFrame, fragments: DataFrame) -> DataFrame:
    """type, n_pairs, duplicated_lines (those of each pair's first fragment)."""
    lines = fragments.select(F.col("id").alias("a"), "n_lines")
    return links.join(lines, "a").groupBy("type").agg(F.count("*").alias("n_pairs"), F.sum("n_lines").alias("duplicated_lines"))


def same_shape(functions: DataFrame, file: str, shape: str, key: str, least: int = 3) -> DataFrame:
    """file, first, other: functions of a file with the same list of over `least` statement types, each with the
    first of them."""
    some = functions.filter(F.size(shape) > least)
    first = some.groupBy(file, shape).agg(F.min(key).alias("first"))
    return some.join(first, [file, shape]).filter(F.col(key) > F.col("first")).select(file, "first", F.col(key).alias("other"))
