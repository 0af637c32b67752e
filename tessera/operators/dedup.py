"""Exact duplicates: groups by content hash, originals, wasted space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_groups(files: DataFrame, content_hash: Column, size: str, key: str) -> DataFrame:
    """hash, n_files, original_id, file_chars, wasted_chars of every content that occurs more than
    once. One hash aggregation with partial sums; null content is in no group."""
    hashed = files.select(F.col(key), F.col(size), content_hash.alias("hash")).filter("hash is not null")
    groups = hashed.groupBy("hash").agg(F.count("*").alias("n_files"), F.min(key).alias("original_id"), F.max(size).alias("file_chars"))
    return groups.filter("n_files > 1").withColumn("wasted_chars", (F.col("n_files") - 1) * F.col("file_chars"))


def original_map(files: DataFrame, content_hash: Column, order: Sequence[Column], key: str) -> DataFrame:
    """(key, original): each duplicate and the original of its content, the first by `order` and key.

    The original is an aggregate (`min` of a struct), so that a content with a third of all rows is
    combined before the shuffle and joined back, not sorted in one task.
    """
    rows = files.select(F.col(key), content_hash.alias("hash"), F.struct(*order, F.col(key)).alias("rank")).filter("hash is not null")
    first = rows.groupBy("hash").agg(F.min("rank").alias("best"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, "hash").filter(F.col("rank") != F.col("best")).select(F.col(key), F.col(f"best.{key}").alias("original"))


def summary(files: DataFrame, content_hash: Column, size: str, key: str) -> DataFrame:
    """One row: files, distinct contents, groups, duplicates, wasted and largest group."""
    hashed = files.select(F.col(size), content_hash.alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.max(size).alias("size"))
    more = F.col("n") > 1
    return hashed.agg(
        F.sum("n").alias("total_files"),
        F.count("*").alias("unique_files"),
        F.sum(more.cast("long")).alias("duplicate_groups"),
        F.sum(F.col("n") - 1).alias("duplicate_files"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("wasted_chars"),
        F.max("n").alias("largest_group"),
    )


def without_duplicates(files: DataFrame, duplicates: DataFrame, key: str) -> DataFrame:
    """Files that are no duplicate of an original."""
    return files.join(duplicates.select(key), key, "left_anti")


def elect(rows: DataFrame, group: Sequence[str], score: Column, tie: str) -> DataFrame:
    """`rows` with score, rank, master (rank 1) and confidence of the master from the gap to the second.

    Confidence is 0.5 + half the relative gap, 1 at most; 0.5 if no score is positive.
    """
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col(tie))
    ranked = rows.withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w))
    gap = F.col("score") - F.coalesce("next_score", F.lit(0.0))
    confidence = F.when(F.col("score") > 0, F.least(F.lit(1.0), 0.5 + 0.5 * gap / F.col("score"))).otherwise(0.5)
    return ranked.withColumn("confidence", F.when(F.col("rank") == 1, F.round(confidence, 4)))
