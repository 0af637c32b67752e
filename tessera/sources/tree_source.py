"""A file tree as a Spark data source, `file_tree`, and the members of zip archives by ranges of bytes.

The folder must be mounted under the same path on the driver and all executors; for other storage use
`files.listing`, which goes through Spark's own file readers.
"""

from __future__ import annotations

import datetime
import operator
import os
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tessera.functions.text import IGNORED_PARTS

SCHEMA = "path string, folder string, name string, extension string, length long, modified timestamp, error string"
COMPARE = {ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge}


class Piece(ds.InputPartition):
    """A folder: its own files, or (`deep`) all that is below it."""

    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class Entry(NamedTuple):
    folders: list[str]
    files: list[os.DirEntry]
    error: str | None


def look(folder: str, ignored: frozenset[str]) -> Entry:
    """What is right in a folder, in order of names; ignored folders aren't entered, links to folders aren't followed."""
    try:
        with os.scandir(folder) as it:
            found = sorted(it, key=lambda e: e.name)
        inner = [e.path for e in found if e.is_dir(follow_symlinks=False) and e.name not in ignored]
        return Entry(inner, [e for e in found if e.is_file()], None)
    except OSError as e:
        return Entry([], [], type(e).__name__)


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        root = options.get("path")
        if not root or "://" in root:
            raise ValueError("path must be a mounted folder; use files.listing for other storage")
        self.root = os.path.abspath(root.removeprefix("file:"))
        self.parts = int(options.get("parts", "64"))
        self.ignored = frozenset(options["ignored"].split(",") if "ignored" in options else IGNORED_PARTS)
        self.extensions: frozenset[str] | None = None
        self.lengths: list[tuple] = []

    def partitions(self) -> list[Piece]:
        """Folders from the top down, until `parts` of them are open; the driver lists only those that it opens, in the order of
        levels. An open folder's own files are a piece, a folder that stays closed is one with all below it."""
        closed, own = [self.root], []
        while closed and len(closed) + len(own) < self.parts:
            folder = closed.pop(0)
            own.append(Piece(folder, False))
            closed += look(folder, self.ignored).folders
        return own + [Piece(c, True) for c in closed]

    def read(self, piece: Piece) -> Iterator[tuple]:
        waiting = [piece.folder]
        while waiting:
            folder = waiting.pop()
            found = look(folder, self.ignored)
            if found.error:
                yield (folder, os.path.dirname(folder), os.path.basename(folder), None, None, None, found.error)
            for e in found.files:
                extension = os.path.splitext(e.name)[1].lower()
                if self.extensions is not None and extension not in self.extensions:
                    continue
                try:
                    stat = e.stat()
                except OSError as why:
                    yield (e.path, folder, e.name, extension, None, None, type(why).__name__)
                    continue
                if all(holds(stat.st_size, v) for holds, v in self.lengths):
                    yield (e.path, folder, e.name, extension, stat.st_size, datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC), None)
            if piece.deep:
                waiting += found.folders


class PushingReader(TreeReader):
    """Spark takes a reader with pushFilters only in sessions that allow it."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Endings are tested before a file's size is asked for, sizes where the tree is walked; Spark keeps the others."""
        for f in filters:
            where = getattr(f, "attribute", None)
            if where == ("length",) and type(f) in COMPARE:
                self.lengths.append((COMPARE[type(f)], f.value))
            elif where == ("extension",) and isinstance(f, (ds.EqualTo, ds.In)):
                wanted = frozenset(f.value if isinstance(f, ds.In) else [f.value])
                self.extensions = wanted if self.extensions is None else self.extensions & wanted
            else:
                yield f


class FileTree(ds.DataSource):
    """spark.read.format("file_tree").option("parts", n).option("ignored", "a,b").load(root); option `push` for filters in the walk."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return (PushingReader if self.options.get("push") == "true" else TreeReader)(dict(self.options))


def tree(spark: SparkSession, root: str, parts: int = 64, ignored: tuple[str, ...] = IGNORED_PARTS) -> DataFrame:
    """path, folder, name, extension, length, modified, error of each file below `root`, listed in parallel tasks; a folder or file that
    can't be read is a row with an error. Filters on `length` and `extension` reach the walk if the session
    has spark.sql.python.filterPushdown.enabled; else Spark applies them."""
    spark.dataSource.register(FileTree)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("file_tree").option("push", push.lower()).option("parts", parts).option("ignored", ",".join(ignored)).load(root)


#: Bytes of an archive whose members a task reads, by where they start.
RANGE = 64 << 20


def zip_members(archives: DataFrame, max_bytes: int = 50 << 20, span: int = RANGE) -> DataFrame:
    """path, member, length, content, error of the files in the zip archives `archives` (path, length).

    An archive is cut into ranges of `span` bytes, and each member belongs to the range in which it starts, so that those of one
    large archive are read by many tasks. Members over `max_bytes` are told without content; broken archives and members are rows with an error, of their first range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "length", "content", "error"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
        for batch in batches:
            for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(path) as z:
                        for i in z.infolist():
                            if i.is_dir() or i.header_offset // span != part:
                                continue
                            if i.file_size > max_bytes:
                                yield one(path, i.filename, i.file_size, None, "too_large")
                                continue
                            try:
                                yield one(path, i.filename, i.file_size, z.read(i), None)
                            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError) as e:
                                yield one(path, i.filename, i.file_size, None, type(e).__name__)
                except (zipfile.BadZipFile, OSError) as e:
                    if part == 0:
                        yield one(path, None, None, None, type(e).__name__)

    last = F.floor(F.greatest(F.coalesce("length", F.lit(0)) - 1, F.lit(0)) / span)
    ranges = archives.filter("path is not null").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    return ranges.repartition("path", "part").mapInArrow(work, "path string, member string, length long, content binary, error string")
