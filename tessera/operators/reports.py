"""Reports and states as rows: text index, queries in words, decisions, deliveries, fusion, documents and layouts.

Reports are one row per line or block, in order of a position, so that a writer can save them without
gathering them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that name what is looked for, and those that a query's keywords leave out.
TARGETS = {"function": "function", "functions": "function", "method": "function", "class": "class", "classes": "class", "import": "import", "imports": "import", "variable": "variable", "file": "file"}
STOP = frozenset("a an the of in on for with without that which is are to all find show list me and or not".split())
#: Lines of other languages that the text index knows.
DEFINITIONS = r"^\s*(?:export\s+)?(?:async\s+)?(function|class|def|interface|type|const)\s+([A-Za-z_$][A-Za-z0-9_$]*)"


def text_index(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, name): one row per line that defines something."""
    lines = files.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line_text"))
    found = lines.select("key", (F.col("pos") + 1).alias("line"), F.regexp_extract("line_text", DEFINITIONS, 1).alias("kind"), F.regexp_extract("line_text", DEFINITIONS, 2).alias("name"))
    return found.filter("kind <> ''")


def parse_query(query: str) -> dict:
    """Target, keywords, negated words and path filter of a query in words."""
    negated = re.findall(r"\b(?:without|not|except)\s+(\w+)", query.lower())
    inside = re.search(r"\bin\s+(\S+[/.]\S*)", query.lower())
    rest = re.sub(r"\b(?:without|not|except)\s+\w+", " ", query.lower())
    rest = rest.replace(inside.group(0), " ") if inside else rest
    words = re.findall(r"\w+", rest)
    target = next((TARGETS[w] for w in words if w in TARGETS), None)
    return {"target": target, "keywords": [w for w in words if w not in STOP and w not in TARGETS], "negations": negated, "path": inside.group(1) if inside else None}


def query_filter(rows: DataFrame, asked: dict, name: str, path: str, kind: str, score: str) -> DataFrame:
    """`rows` without negated names and other paths; rows of the target kind score half as much again."""
    out = rows
    for w in asked["negations"]:
        out = out.filter(~F.contains(F.lower(name), F.lit(w)))
    if asked["path"]:
        out = out.filter(F.contains(F.lower(path), F.lit(asked["path"])))
    boost = F.when(F.col(kind) == asked["target"], 1.5).otherwise(1.0) if asked["target"] else F.lit(1.0)
    return out.withColumn(score, F.col(score) * boost)


def consistency(decisions: DataFrame, situation: list[str], choice: str, at: str, last: int = 50, least: int = 3) -> DataFrame:
    """One row: over the `last` decisions whose situation was met `least` times or more, the mean share of
    those that chose alike; 0 without any."""
    alike = decisions.groupBy(*situation).agg(F.count("*").alias("_n"))
    same = decisions.groupBy(*situation, choice).agg(F.count("*").alias("_m"))
    recent = decisions.orderBy(F.desc(at)).limit(last)
    rated = recent.join(alike, situation).join(same, [*situation, choice]).filter(F.col("_n") >= least)
    return rated.agg(F.count("*").alias("n_rated"), F.round(F.coalesce(F.avg(F.col("_m") / F.col("_n")), F.lit(0.0)), 4).alias("consistency"))


def delivery_stats(deliveries: DataFrame, hook: str, ok: Column, duration: str) -> DataFrame:
    """hook, total, succeeded, success_rate, mean_duration (durations of zero aside)."""
    return deliveries.groupBy(hook).agg(
        F.count("*").alias("total"), F.sum(ok.cast("long")).alias("succeeded"), F.round(F.avg(ok.cast("double")), 4).alias("success_rate"), F.round(F.avg(F.nullif(F.col(duration), F.lit(0.0))), 4).alias("mean_duration")
    )


def delivery_history(deliveries: DataFrame, at: str, key: str, where: Column, n: int = 100) -> DataFrame:
    """The last n deliveries that pass the filter."""
    return deliveries.filter(where).orderBy(F.desc(at), F.desc(key)).limit(n)


def fusion_base(versions: DataFrame, group: str, path: str, functions: str, classes: str, complexity: str, lines: str) -> DataFrame:
    """The version that a fusion starts from: 10 a function, 15 a class, the complexity and the lines; the first of equals."""
    score = 10 * F.col(functions) + 15 * F.col(classes) + F.col(complexity) + F.col(lines)
    best = versions.withColumn("score", score)
    w = Window.partitionBy(group).orderBy(F.desc("score"), path)
    return best.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(group, F.col(path).alias("base"), "score")


def conflict_status(conflicts: DataFrame, strategy: Column) -> DataFrame:
    """Conflicts of the strategy `manual` wait; all others are settled for the base version."""
    return conflicts.withColumn("status", F.when(strategy == "manual", "pending").otherwise("resolved"))


def fusion_report(base: DataFrame, conflicts: DataFrame, group: str) -> DataFrame:
    """(group, line): the lines of each group's report in order."""
    counts = conflicts.groupBy(group).agg(F.count("*").alias("_n"), F.sum((F.col("status") == "pending").cast("long")).alias("_p"))
    rows = base.join(counts, group, "left").na.fill(0, ["_n", "_p"])
    lines = F.array(F.concat(F.lit("Base: "), F.col("base").cast("string")), F.concat(F.lit("Conflicts: "), F.col("_n").cast("string")), F.concat(F.lit("Pending: "), F.col("_p").cast("string")))
    return rows.select(group, F.posexplode(lines).alias("pos", "line"))


def class_diagram(classes: DataFrame) -> DataFrame:
    """(pos, line): Mermaid lines of `classes` (name, bases): the class, then an arrow from each of its bases."""
    own = classes.select("name", F.lit(0).alias("part"), F.concat(F.lit("class "), "name").alias("line"))
    arrows = classes.select("name", F.posexplode("bases").alias("p", "b")).select("name", (F.col("p") + 1).alias("part"), F.concat("b", F.lit(" <|-- "), "name").alias("line"))
    return own.unionByName(arrows)


def html_rows(rows: DataFrame, columns: list[str]) -> Column:
    """A table row of HTML with escaped cells."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))


def layout(files: DataFrame, folder: Column, path: str) -> DataFrame:
    """(folder, n_files, entry): a JSON text per proposed folder with its files in order."""
    return files.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_list(path)).alias("files")).select("folder", F.size("files").alias("n_files"), F.to_json(F.struct("folder", "files")).alias("entry"))


def merged_states(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The union of two saved states, one row per key: the latest, and of equals the old one's."""
    both = old.withColumn("_s", F.lit(1)).unionByName(new.withColumn("_s", F.lit(0)))
    kept = both.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in old.columns]), F.struct(at, "_s")).alias("m"))
    return kept.select("m.*")


def updated_settings(defaults: DataFrame, given: DataFrame) -> DataFrame:
    """(name, settings): maps of defaults with the given entries put over them."""
    over = given.select("name", F.col("settings").alias("_g"))
    keep = F.map_filter("settings", lambda k, v: ~F.map_contains_key("_g", k))
    merged = F.when(F.col("_g").isNull(), F.col("settings")).otherwise(F.map_concat(keep, F.col("_g")))
    return defaults.join(over, "name", "left").select("name", merged.alias("settings"))


def phase_summary(files: DataFrame, failed: Column, measures: list[str]) -> DataFrame:
    """One row: processed, failed, and the sum of each measure over those that didn't fail."""
    return files.agg(F.count("*").alias("processed"), F.sum(failed.cast("long")).alias("failed"), *[F.sum(F.when(~failed, F.col(m))).alias(f"total_{m}") for m in measures])
