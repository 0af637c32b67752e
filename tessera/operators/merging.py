"""Three-way merges of texts over line matches, and checks of merged sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import python_source
from tessera.operators.diffs import matches

REGION = "region int, kind string, base_start int, base_lines int, ours array<string>, theirs array<string>"
#: Marks around the two sides of a conflict.
MARKS = ("<<<<<<< ours", "=======", ">>>>>>> theirs")

Region = tuple[str, int, int, list[str], list[str]]


def regions(base: list[str], ours: list[str], theirs: list[str]) -> list[Region]:
    """(kind, lines of the base before it, its lines of the base, ours, theirs), in order.

    A base line that both sides keep is stable. A run of stable lines is `same`; what lies between two of them is `ours` or
    `theirs` if only that side changed it, `both` if both made it the same, else `conflict`."""
    kept, also = dict(matches(base, ours)), dict(matches(base, theirs))
    stable = [(x, y, also[x]) for x, y in kept.items() if x in also]
    out: list[Region] = []
    i = j = k = begin = 0

    def close(upto: int) -> None:
        if upto > begin:
            out.append(("same", begin, upto - begin, base[begin:upto], base[begin:upto]))

    for x, y, z in [*sorted(stable), (len(base), len(ours), len(theirs))]:
        if (x, y, z) != (i, j, k):
            close(i)
            old, a, b = base[i:x], ours[j:y], theirs[k:z]
            kind = "ours" if b == old else "theirs" if a == old else "both" if a == b else "conflict"
            out.append((kind, i, x - i, a, b))
            begin = x
        i, j, k = x + 1, y + 1, z + 1
    close(len(base))
    return out


def three_way(rows: DataFrame, key: str, base: str, ours: str, theirs: str) -> DataFrame:
    """(key, region, kind, base_start, base_lines, ours, theirs): the regions of each merge, numbered from 1; `base_start` counts
    the lines of the base before the region.

    Texts are split at line feeds; null or empty is a text without lines. Both sides changed alike aren't in conflict; a line
    added by both at one place is, unless it is the same. One merge is one row's work."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["key", *(c.split()[0] for c in REGION.split(", "))]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda t: t.split("\n") if t else []
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("base", "ours", "theirs")]
            found = [(at, n, *r) for at, texts in enumerate(zip(*sides, strict=True)) for n, r in enumerate(regions(*map(split, texts)), 1)]
            at, *columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    text = lambda c, name: F.col(c).cast("string").alias(name)
    return rows.select(F.col(key).alias("key"), text(base, "base"), text(ours, "ours"), text(theirs, "theirs")).mapInArrow(work, f"key {kind}, {REGION}")


def merged(found: DataFrame) -> DataFrame:
    """(key, text, n_conflicts, n_changes): the merged text of `three_way`'s regions, conflicts between marks. Merges of texts without
    any line have no regions and no row."""
    marked = F.concat(F.array(F.lit(MARKS[0])), "ours", F.array(F.lit(MARKS[1])), "theirs", F.array(F.lit(MARKS[2])))
    lines = F.when(F.col("kind") == "conflict", marked).when(F.col("kind") == "theirs", F.col("theirs")).otherwise(F.col("ours"))
    each = found.select("key", "kind", F.struct("region", lines.alias("lines")).alias("piece"))
    joined = each.groupBy("key").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.sum((F.col("kind") == "conflict").cast("int")).alias("n_conflicts"),
        F.sum((F.col("kind") != "same").cast("int")).alias("n_changes"),
    )
    return joined.select("key", F.array_join(F.flatten("pieces.lines"), "\n").alias("text"), "n_conflicts", "n_changes")


def checks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, syntax_valid, error_line, n_imports, duplicates, success) of each source.

    `duplicates` names each module that is imported again, once for every further import, sorted; names of
    relative imports count without their dots, those of dots alone aren't counted. A source succeeds if it parses and imports no module
    twice. A null text is an empty module."""
    rows = python_source.parse(files, path, text).filter(F.col("kind").isin("error", "import"))
    module = F.regexp_replace("name", r"^\.+", "")
    named = rows.filter("kind = 'import'").withColumn("module", module).filter("module <> ''").groupBy("path", "module").agg(F.count("*").alias("n"))
    again = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("module", "n"))), lambda m: F.array_repeat(m["module"], (m["n"] - 1).cast("int"))))
    imports = named.groupBy("path").agg(F.sum("n").alias("n_imports"), again.alias("duplicates"))
    errors = rows.filter("kind = 'error'").groupBy("path").agg(F.min("lineno").alias("error_line"))
    out = files.select(F.col(path).alias("path")).join(imports, "path", "left").join(errors, "path", "left")
    valid, twice = F.col("error_line").isNull(), F.coalesce("duplicates", F.array().cast("array<string>"))
    return out.select("path", valid.alias("syntax_valid"), "error_line", F.coalesce("n_imports", F.lit(0)).alias("n_imports"), twice.alias("duplicates"), (valid & (F.size(twice) == 0)).alias("success"))
