"""Trees of files as DataFrames: metadata, admission, hashes, archives, snapshots, exported logs."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import basename, is_archive, is_ignored, suffix

MAX_BYTES = 50 << 20
MEMBER = "path string, member string, length long, content binary, error string"


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modified of all files below root. The content column is pruned from the scan."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return df.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"))


def scan(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, name, extension, length, modified, status, md5, sha256, text of each file.

    status is archive, ignored, other_type, too_large or ok; only files that are ok have hashes and text.
    Text is UTF-8 with bad bytes replaced.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    ext = suffix(path)
    status = F.when(is_ignored(path), "ignored").when(is_archive(path), "archive")
    if extensions is not None:
        status = status.when(~ext.isin(list(extensions)), "other_type")
    status = status.when(F.col("length") > max_bytes, "too_large").otherwise("ok")
    ok = F.when(status == "ok", F.col("content"))
    return df.select(
        path.alias("path"), basename(path).alias("name"), ext.alias("extension"), "length", F.col("modificationTime").alias("modified"), status.alias("status"),
        F.md5(ok).alias("md5"), F.sha2(ok, 256).alias("sha256"), F.when(status == "ok", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
    )


def archive_members(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, member, length, content, error of the files inside zip and tar archives.

    Members are read in memory, never unpacked to a path; larger ones are reported with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(is_archive(F.col("path")))

    def members(path: str, data: bytes) -> Iterator[tuple]:
        try:
            if zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield i.filename, i.file_size, lambda i=i: z.read(i)
            else:
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile():
                            yield m.name, m.size, lambda m=m: t.extractfile(m).read()
        except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
            yield None, None, lambda e=e: e

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                for name, size, read in members(path, bytes(data)):
                    if name is None:
                        row = (path, None, None, None, type(read()).__name__)
                    elif extensions is not None and not name.lower().endswith(tuple(extensions)):
                        continue
                    else:
                        row = (path, name, size, None, "too_large") if size > max_bytes else (path, name, size, read(), None)
                    yield pd.DataFrame([row], columns=["path", "member", "length", "content", "error"]).astype({"length": "Int64"})

    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").mapInPandas(work, MEMBER)


def folders(files: DataFrame, root: str) -> DataFrame:
    """folder, n_files, bytes of each entry right below root."""
    top = F.split(F.substring("path", len(root.rstrip("/")) + 2, 10_000), "/")[0]
    return files.groupBy(top.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def history_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, time, subject of an exported log of lines commit|author|time|subject."""
    parts = F.split("value", r"\|", 4)
    return spark.read.text(path).filter(F.size(parts) == 4).select(parts[0].alias("commit"), parts[1].alias("author"), F.to_timestamp(parts[2]).alias("time"), parts[3].alias("subject"))
