"""Shared storage: where jobs cut their lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "/tmp/checkpoints"
#: The tables written in the innermost `scratch`.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`.

    The setting is read from the session; only where it is unset (as in local tests)
    a folder of this machine stands in.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or FALLBACK).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that are written inside, but for those to be kept, are deleted at its end. What leaves it must rest on kept tables only."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            drop_path(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back.

    This cuts the lineage: later jobs re-read committed files, so a lost executor costs
    no recomputation and non-deterministic steps (range sampling) are fixed once. The table outlives
    a `scratch` around it only if `keep`.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if not keep and (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
