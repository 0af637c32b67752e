"""Versions of a file over time: timelines, deltas, likely originals, element selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import depth, matches_any


def timeline(versions: DataFrame, group: str, time: str, tie: str, measures: Sequence[str]) -> DataFrame:
    """Each version with pos and, from its group's first version, seconds and deltas of the measures."""
    w = Window.partitionBy(group).orderBy(time, tie)
    out = versions.withColumn("pos", F.row_number().over(w))
    out = out.withColumn("seconds_from_first", F.unix_timestamp(F.col(time)) - F.unix_timestamp(F.first(time).over(w)))
    return out.withColumns({f"{m}_delta": F.col(m) - F.first(m).over(w) for m in measures})


def first_and_last(versions: DataFrame, group: str, time: str, key: str) -> DataFrame:
    """group, oldest, newest, n: aggregates, no sort."""
    return versions.groupBy(group).agg(F.min(F.struct(time, key)).getField(key).alias("oldest"), F.max(F.struct(time, key)).getField(key).alias("newest"), F.count("*").alias("n_versions"))


def likely_original(versions: DataFrame, group: str, path: str, time: str) -> DataFrame:
    """group, path, score of the version with the most points: 30 oldest, 15 least depth, 10 in a source
    folder, -20 named like a backup; ties by path."""
    d = depth(F.col(path))
    best = versions.groupBy(group).agg(F.min(time).alias("_first"), F.min(d).alias("_least"))
    points = (
        F.when(F.col(time) == F.col("_first"), 30).otherwise(0)
        + F.when(d == F.col("_least"), 15).otherwise(0)
        + F.when(matches_any(F.col(path), ("src/", "lib/", "core/")), 10).otherwise(0)
        - F.when(matches_any(F.col(path), ("backup", "copy", "old", "bak")), 20).otherwise(0)
    )
    scored = versions.join(best, group).select(group, path, points.alias("score"))
    top = scored.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(path).alias("p"))).alias("m"))
    return top.select(group, F.col("m.p").alias(path), (-F.col("m.s")).alias("score"))


def best_per_name(elements: DataFrame, name: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """The value of each name's element that is last by `order`: one `max_by`, no sort."""
    return elements.groupBy(*name).agg(F.max_by(value, F.struct(*order)).alias(value))


def conflicts(elements: DataFrame, name: Sequence[str], code_hash: str, version: str) -> DataFrame:
    """Names whose code differs between versions."""
    grouped = elements.groupBy(*name).agg(F.count_distinct(code_hash).alias("n_variants"), F.array_sort(F.collect_set(version)).alias("versions"))
    return grouped.filter("n_variants > 1")


def fuse(elements: DataFrame, group: str, kind: str, name: str, source: str, rank: str) -> DataFrame:
    """group, code: imports sorted, then each class's and function's source from the version of the least
    rank that has it, by kind, rank and name. Elements, not versions, are gathered per group."""
    first = elements.groupBy(group, kind, name).agg(F.min_by(F.struct(rank, source), rank).alias("v"))
    order = F.when(F.col(kind) == "import", 0).when(F.col(kind) == "class", 1).otherwise(2)
    piece = F.struct(order.alias("o"), F.when(F.col(kind) == "import", 0).otherwise(F.col(f"v.{rank}")).alias("r"), F.col(name).alias("n"), F.col(f"v.{source}").alias("s"))
    joined = first.groupBy(group).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return joined.select(group, F.array_join(F.col("p.s"), "\n").alias("code"), F.size("p").alias("n_elements"))
