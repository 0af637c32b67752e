"""Catalog access: search, paging, listing, statistics, histograms and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, column: str, needle: str, literal: bool = False) -> DataFrame:
    """Rows whose column holds the needle in any case. `%` and `_` are wildcards unless `literal`."""
    if literal:
        return rows.filter(F.contains(F.lower(column), F.lit(needle.lower())))
    return rows.filter(F.col(column).ilike(f"%{needle}%"))


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; end `order` with a unique column."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def search_kinds(kinds: dict[str, tuple[DataFrame, str, str]], needle: str, limit: int) -> DataFrame:
    """kind, id, name: the first `limit` hits by (name, id) of each kind. A top-k per input, not a
    window over all hits."""
    parts = [
        search(rows, name, needle).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name")).orderBy("name", "id").limit(limit)
        for kind, (rows, key, name) in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n: one aggregation per table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in tables.items()])


def parents_with_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, keep: Sequence[str]) -> DataFrame:
    """`keep` columns of each parent and n_children, zero included. Children are counted before the
    join, so a parent with most of them is one row there."""
    counted = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("n_children"))
    joined = parents.join(counted, F.col(parent_key) == F.col("_k"), "left")
    return joined.select(*keep, F.coalesce("n_children", F.lit(0)).alias("n_children"))


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values; ties in order of the value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def users_of(rows: DataFrame, module: str, user: str) -> DataFrame:
    """module, users: the distinct users of each, sorted and joined by commas."""
    pairs = rows.select(module, user).distinct()
    return pairs.groupBy(module).agg(F.array_join(F.array_sort(F.collect_list(user)), ",").alias("users"), F.count("*").alias("n_users"))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark turns the filtered rank into a limit before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def histogram(rows: DataFrame, label: Column) -> DataFrame:
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def unique_and_common(rows: DataFrame, element: str, version: str) -> DataFrame:
    """element, n_versions, place: in one version only, in all, or in some."""
    total = rows.agg(F.countDistinct(version).alias("total"))
    per = rows.groupBy(element).agg(F.countDistinct(version).alias("n_versions"))
    place = F.when(F.col("n_versions") == F.col("total"), "common").when(F.col("n_versions") == 1, "unique").otherwise("shared")
    return per.join(F.broadcast(total)).select(element, "n_versions", place.alias("place"))


def used(rows: DataFrame, users: DataFrame, key: str, user_key: str, unused: bool = False) -> DataFrame:
    """Rows that some user names, or that none does. Null keys on the user's side never hide rows."""
    return rows.join(users.select(F.col(user_key).alias("_u")), F.col(key) == F.col("_u"), "left_anti" if unused else "left_semi")


def pivot_by(rows: DataFrame, key: str, kind: Column, value: str, kinds: Iterable[str]) -> DataFrame:
    """key and, for each kind, the number of its values and the last: bounded states, so a key may hold
    any share of the rows."""
    aggs = [a for k in kinds for a in (F.count(F.when(kind == k, 1)).alias(f"n_{k}"), F.max(F.when(kind == k, F.col(value))).alias(f"last_{k}"))]
    return rows.groupBy(key).agg(*aggs)
