"""Snapshots as trees of folder digests: two are compared by descending only where digests differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import materialize

#: Folders of the storage layout that files and folders are spread over by their parent.
SHARDS = 64


@dataclass(frozen=True)
class Tree:
    """A stored snapshot: its folders by level and shard of the parent, its files by shard of their folder."""

    folders: DataFrame
    files: DataFrame


def _shard(folder: Column) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(SHARDS)).cast("int")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def folders(files: DataFrame) -> DataFrame:
    """(folder, level, parent, n_files, n_own, bytes, own, below) of the files (path, digest, size).

    `below` is the digest of all files under a folder, `own` of those directly in it: sums of two 64-bit hashes of path and
    content, which don't depend on the order. So a folder of any number of files is one sum, combined before the shuffle, and no
    level waits for the one under it. The top is the folder ''. A null path is left out, a null digest is one value of its own; give one row for
    each path."""
    parts = F.split(_parent(F.col("path")), "/")
    depth = F.when(_parent(F.col("path")) == "", 0).otherwise(F.size(parts))
    known = files.filter("path is not null").select("path", "size", parts.alias("parts"), depth.alias("depth"), F.xxhash64("path", "digest").alias("h"), F.xxhash64("digest", "path", F.lit(1)).alias("g"))
    each = known.select("*", F.explode(F.sequence(F.lit(0), "depth")).alias("level")).withColumn("folder", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/"))
    direct = F.col("level") == F.col("depth")
    total = lambda c, which=None: F.sum((F.col(c) if which is None else F.when(which, F.col(c)).otherwise(F.lit(0))).cast("decimal(38,0)"))
    out = each.groupBy("folder", "level").agg(
        F.count("*").alias("n_files"), F.count_if(direct).alias("n_own"), F.sum("size").alias("bytes"), F.struct(total("h", direct), total("g", direct)).alias("own"), F.struct(total("h"), total("g")).alias("below")
    )
    text = lambda c: F.concat_ws(":", F.col(f"{c}.col1").cast("string"), F.col(f"{c}.col2").cast("string"))
    return out.select("folder", "level", F.when(F.col("level") > 0, _parent(F.col("folder"))).alias("parent"), "n_files", "n_own", "bytes", text("own").alias("own"), text("below").alias("below"))


def store(files: DataFrame, at: str) -> Tree:
    """Write a snapshot (path, digest, size) as a tree below the shared folder `at`."""
    spark = files.sparkSession
    known = files.filter("path is not null").select("path", "digest", "size").withColumn("folder", _parent(F.col("path"))).withColumn("shard", _shard(F.col("folder")))
    known.repartition("shard").write.partitionBy("shard").parquet(f"{at}/files")
    above = folders(files).withColumn("shard", _shard(F.coalesce("parent", F.lit(""))))
    above.repartition("level", "shard").write.partitionBy("level", "shard").parquet(f"{at}/folders")
    return load(spark, at)


def load(spark: SparkSession, at: str) -> Tree:
    """A tree that `store` wrote."""
    return Tree(
        spark.read.schema("folder string, parent string, n_files long, n_own long, bytes long, own string, below string, level int, shard int").parquet(f"{at}/folders"),
        spark.read.schema("path string, digest string, size long, folder string, shard int").parquet(f"{at}/files"),
    )


def _of(side: DataFrame, above: DataFrame, folder: str) -> DataFrame:
    """The rows of `side` whose `folder` is one of `above` (folder, shard). The shards, `SHARDS` numbers at most, come to the driver as
    a filter of partitions, so the others aren't read."""
    shards = [r[0] for r in above.select("shard").distinct().collect()]
    some = side.filter(F.col("shard").isin(shards))
    return some.join(above, (some["shard"] == above["shard"]) & (some[folder] == above["folder"]), "left_semi")


def changed_folders(old: Tree, new: Tree) -> DataFrame:
    """(folder, level, own): folders whose files, at any depth, differ; `own` tells whether files directly in it do.

    Level by level, only partitions that hold children of folders that differ are read."""
    spark = old.folders.sparkSession
    deepest = old.folders.select("level").union(new.folders.select("level")).agg(F.max("level")).first()[0]
    found, above = None, None
    for level in range(0, (deepest if deepest is not None else -1) + 1):
        sides = [t.folders.filter(F.col("level") == level).select("folder", "parent", "shard", "own", "below") for t in (old, new)]
        if above is not None:
            sides = [_of(s, above, "parent") for s in sides]
        x, y = (s.select("folder", F.col("own").alias(f"own{i}"), F.col("below").alias(f"below{i}")) for i, s in enumerate(sides))
        both = x.join(y, "folder", "full").filter("not (below0 <=> below1)").select("folder", F.lit(level).alias("level"), (~F.col("own0").eqNullSafe(F.col("own1"))).alias("own"))
        here = materialize(both, "changed")
        found = here if found is None else found.unionByName(here)
        if here.isEmpty():
            break
        above = here.select("folder", _shard(F.col("folder")).alias("shard"))
    return found if found is not None else spark.createDataFrame([], "folder string, level int, own boolean")


def changes(old: Tree, new: Tree) -> DataFrame:
    """(path, change): files created, modified or deleted. Only partitions with folders that differ themselves are read."""
    at = materialize(changed_folders(old, new).filter("own").select("folder", _shard(F.col("folder")).alias("shard")), "folders")
    x, y = (_of(t.files, at, "folder").select("path", F.col("digest").alias(f"d{i}"), F.lit(True).alias(f"in{i}")) for i, t in enumerate((old, new)))
    kind = F.when(F.col("in0").isNull(), "created").when(F.col("in1").isNull(), "deleted").when(~F.col("d0").eqNullSafe(F.col("d1")), "modified")
    return x.join(y, "path", "full").select("path", kind.alias("change")).filter("change is not null")
