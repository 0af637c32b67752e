"""Joins whose smaller side is broadcast only while its measured size is bounded, and joins that hot keys don't skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast side may hold, measured before.
BROADCAST_BYTES = 24 << 20
#: So many keys of the most rows, of `LEAST` rows at least, are hot; any other key has under 1 / HOT_KEYS of all rows.
HOT_KEYS, LEAST = 2000, 1000


#: The least number of tasks for each core where rows cost far more than their bytes tell.
TASKS = 3


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` dealt out evenly (or by the columns `by`), to `parts` parts. For rows that are short and costly: by their bytes they
    would be few splits."""
    return rows.repartition(parts(rows.sparkSession), *by)


def parts(spark: SparkSession) -> int:
    """`TASKS` tasks a core or as many as a shuffle has, if that is more."""
    return max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        of = kind.elementType
        flat = 8 if not isinstance(of, T.StructType) else 8 * (len(of.fields) + 2)
        if isinstance(of, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 16
        return F.greatest(F.size(c), F.lit(0)) * flat + 16
    if isinstance(kind, T.StructType):
        out = F.lit(8)
        for f in kind.fields:
            out = out + _bytes(c.getField(f.name), f.dataType)
        return out
    return F.lit(8)


def size_of(df: DataFrame) -> int:
    """About how many bytes the rows of `df` take in memory."""
    each = F.lit(16)
    for f in df.schema.fields:
        each = each + _bytes(F.col(f"`{f.name}`"), f.dataType)
    return int(df.agg(F.sum(each.cast("long"))).first()[0] or 0)


def bounded(keys: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`keys` with a broadcast hint if its rows take at most `most` bytes; else as it is, for a shuffled
    join. Give it a written table: its plan runs once more to measure it."""
    return F.broadcast(keys) if size_of(keys) <= most else keys


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], members: str | None = None) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row for each key `on` at most.

    A `keyed` of few bytes is broadcast. Beyond that, hot keys of `rows` don't meet in one task: their rows of
    `keyed`, at most `HOT_KEYS`, are broadcast (if their bytes are few) and joined where the rows are; the
    others are shuffled. `members` names a column of `keyed` that tells how many rows a key has; else
    they are counted. Give it written tables. Null keys match none.
    """
    if size_of(keyed) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keyed), on)
    counts = keyed.select(*on, F.col(members).alias("_n")) if members else rows.groupBy(*on).agg(F.count("*").alias("_n"))
    found = counts.filter(F.col("_n") >= LEAST).orderBy(F.desc("_n"), *on).limit(HOT_KEYS).select(*on).collect()
    if not found:
        return rows.join(keyed, on)
    heavy = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(*on).schema))
    some = keyed.join(heavy, on, "left_semi")
    return rows.join(heavy, on, "left_anti").join(keyed, on).unionByName(rows.join(bounded(some), on))
