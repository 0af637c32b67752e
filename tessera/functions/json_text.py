"""JSON texts as columns: validity, distinct paths, values at a path; all with Spark's own JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import materialize


def valid(text: Column) -> Column:
    """Whether the text is JSON; null is not."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def paths(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path): distinct paths of objects and arrays, `$.a.b[]`, to any depth. Each round takes the values of the
    depth before apart, until none is an object or array; strings stay strings, also those that hold JSON. Texts that aren't
    JSON have none. Every depth is written, so that a round reads only the one before."""
    values = files.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.to_json(F.try_parse_json(text)).alias("v"))
    inner = F.col("v").startswith("{") | F.col("v").startswith("[")
    level, levels = materialize(values.filter(inner), "values"), []
    while not level.isEmpty():
        parsed = level.select("key", "path", F.parse_json("v").alias("v"))
        members = parsed.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value"))
        step = F.when(F.col("name").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("."), "name"))
        found = materialize(members.select("key", F.concat("path", step).alias("path"), F.to_json("value").alias("v")), "values")
        levels.append(found.select("key", "path"))
        level = found.filter(inner)
    out = level.select("key", "path")
    for found in levels:
        out = out.union(found)
    return out.distinct()


def value_at(text: Column, path: str) -> Column:
    """The value at a path such as `$.a[0].b`, as text; null if there is none. The root may be an array."""
    return F.get_json_object(text, path)
