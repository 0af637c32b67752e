"""Writers: reports, graphs and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row in a column `value`, for `write.text`."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def csv_report(groups: DataFrame, path: str) -> None:
    """Groups as CSV: arrays joined by "; ", doubles with four places."""
    columns = []
    for name, kind in groups.dtypes:
        c = F.col(name)
        columns.append((F.array_join(c, "; ") if kind.startswith("array") else F.format_string("%.4f", c) if kind == "double" else c).alias(name))
    groups.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown_rows(groups: DataFrame, title: str, facts: list[str]) -> DataFrame:
    """value: a Markdown section of each row, with its facts as a list."""
    lines = [F.concat(F.lit("## "), F.col(title).cast("string"))] + [F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("-"))) for f in facts]
    return groups.select(F.concat_ws("\n", *lines).alias("value"))


def graph_rows(edges: DataFrame, form: str) -> DataFrame:
    """value: one line per edge in DOT, Mermaid or JSON form. The frame lines are the caller's."""
    if form == "dot":
        return edges.select(F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    if form == "mermaid":
        node = lambda c: F.concat(F.lit("n"), F.abs(F.xxhash64(c)).cast("string"), F.lit('["'), F.col(c).cast("string"), F.lit('"]'))
        return edges.select(F.concat(node("src"), F.lit(" --> "), node("dst")).alias("value"))
    if form == "json":
        return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("value"))
    raise ValueError(f"unknown form {form}")


def replace_partition(rows: DataFrame, path: str, column: str) -> None:
    """Write rows by partition; only the partitions that occur in them are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
