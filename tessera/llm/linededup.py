"""Line dedup (5): content-defined chunks of lines; all in DataFrame functions.

Every line is a 64-bit hash. Only lines that occur more than once in the corpus can belong to a
repeated chunk, so runs of such lines are cut into chunks, and only hashes are shuffled for that:
- a run ends at lines that occur once, around lines of more than `LONG` words (each a chunk of its
  own), and between lines that stand together less than `TOGETHER` times as often as the more
  frequent of them occurs (a common line beside a passage);
- common lines inside a passage, such as blank ones, end no run: the lines on both sides and those
  between are counted as one bridge, and stay together if it is as frequent as `TOGETHER` asks;
- inside a run, a rolling hash over each line and the one before it sets the other boundaries: a
  chunk ends at a local minimum of it, but never leaves a single line over.
Boundaries depend on the lines around them alone, so an inserted line moves no others.

Chunks of two lines or more, or of more than `LONG` words, whose hashes repeat are compared byte
by byte (grouped by their text). The first occurrence stays - least id, then hash of the text, then
place - and the lines of all others are removed, also within one document.

Cases: null and empty texts are one empty line and stay as they are; rows equal in id and text are
one document and treated alike; null ids come last; an empty table gives no rows; other columns
pass through, clashing names included, in the struct `row`; very long texts and lines are hashed and
compared whole; ties of the rolling hash are no boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.joins import bounded, spread_join
from tessera.sources.storage import materialize

LONG = 50
TOGETHER = 0.75
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(keyed: DataFrame) -> DataFrame:
    """(i, t, pos, h, words): one row per line; the text itself stays behind."""
    each = keyed.select("i", "t", F.posexplode(_lines(F.col("body"))).alias("pos", "line"))
    return each.select("i", "t", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).alias("words"))


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """`rows`, a written table, with how many of them share `key` as `name`: null where the key is null.
    Hot keys are counted before the shuffle and don't meet in one task."""
    some = rows.filter(F.col(key).isNotNull())
    counts = materialize(some.groupBy(key).agg(F.count("*").alias(name)), name)
    none = rows.filter(F.col(key).isNull()).withColumn(name, F.lit(None).cast("long"))
    return spread_join(some, counts, [key], name).unionByName(none)


def chunks(lines: DataFrame, long: int = LONG) -> DataFrame:
    """(i, t, start, n, words, c): chunks of repeated lines; c is the hash of their line hashes."""
    often = lines.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1")
    rows = spread_join(lines, materialize(often, "often"), ["h"], "times").distinct()
    by_doc = Window.partitionBy("i", "t").orderBy("pos")
    before = lambda c: F.lag(c).over(by_doc)
    pair = F.when(before("pos") == F.col("pos") - 1, F.xxhash64(before("h"), "h"))
    rows = _counted(materialize(rows.withColumn("pair", pair), "pairs"), "pair", "together")
    after = lambda c: F.lead(c).over(by_doc)
    hard = before("pos").isNull() | (before("pos") != F.col("pos") - 1) | (F.col("words") > long) | (before("words") > long)
    apart = F.col("together") < TOGETHER * F.greatest("times", before("times"))
    rows = rows.withColumns({"hard": hard, "apart": F.coalesce(~hard & apart, F.lit(False))})
    common = (F.col("apart") & (F.col("times") > before("times"))) | (after("apart") & (F.col("times") > after("times")))
    rows = rows.withColumns({"common": F.coalesce(common, F.lit(False)), "stretch": F.sum(F.col("hard").cast("int")).over(by_doc)})
    # A bridge is a line that isn't common, the common ones before it and the last one before those.
    in_stretch = Window.partitionBy("i", "t", "stretch").orderBy("pos")
    last = lambda c: F.last(F.when(~F.col("common"), F.col(c)), True)
    rows = rows.withColumn("from", last("pos").over(in_stretch))
    gap = F.bit_xor(F.when(F.col("common"), F.xxhash64("h", F.col("pos") - F.col("from")))).over(Window.partitionBy("i", "t", "stretch", "from").orderBy("pos"))
    rows = rows.withColumns({"gap": gap, "ends_times": F.greatest("times", last("times").over(in_stretch.rowsBetween(Window.unboundedPreceding, -1)))})
    over = lambda c: F.lag(c).over(in_stretch)
    first = last("h").over(in_stretch.rowsBetween(Window.unboundedPreceding, -1))
    bridge = F.when(~F.col("common") & over("common") & first.isNotNull(), F.xxhash64(first, over("gap"), F.col("pos") - over("from"), "h"))
    rows = materialize(rows.withColumn("bridge", bridge).select("i", "t", "pos", "h", "words", "hard", "apart", "common", "stretch", "ends_times", "bridge"), "runs")
    rows = _counted(rows, "bridge", "crossed")
    rows = rows.withColumn("whole", F.coalesce(F.col("crossed") >= TOGETHER * F.col("ends_times"), F.lit(False)))
    back = Window.partitionBy("i", "t", "stretch").orderBy(F.col("pos").desc())
    inside = F.when(F.col("common"), last("whole").over(back)).otherwise(F.col("whole"))
    rows = rows.withColumn("starts", (F.col("hard") | (F.col("apart") & ~F.coalesce(inside, F.lit(False)))).cast("int"))
    rows = rows.withColumn("run", F.sum("starts").over(by_doc))
    in_run = Window.partitionBy("i", "t", "run").orderBy("pos")
    rows = rows.withColumn("roll", F.xxhash64(F.lag("h").over(in_run), "h"))
    ends = (
        (F.col("roll") < F.lag("roll").over(in_run))
        & (F.col("roll") < F.lead("roll").over(in_run))
        & F.lead("pos", 2).over(in_run).isNotNull()
    )
    rows = rows.withColumn("ends", F.coalesce(ends, F.lit(False)).cast("int"))
    rows = rows.withColumn("part", F.sum("ends").over(in_run) - F.col("ends"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "h")))
    grouped = rows.groupBy("i", "t", "run", "part").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"), F.sum("words").alias("words"), listed.alias("l"))
    return grouped.select("i", "t", "start", "n", "words", F.xxhash64("l.h").alias("c"))


def removals(keyed: DataFrame, long: int = LONG) -> DataFrame:
    """(i, t, cuts): places (start, n) of the chunks to remove from each document."""
    lines = materialize(line_table(keyed), "lines")
    found = materialize(chunks(lines, long).filter((F.col("n") > 1) | (F.col("words") > long)), "chunks")
    again = found.groupBy("c").agg(F.count("*").alias("times")).filter("times > 1")
    some = found.join(again, "c").groupBy("i", "t").agg(F.collect_list(F.struct("start", "n", "c")).alias("own"))
    some = materialize(some, "repeated").withColumnsRenamed({"i": "_i", "t": "_t"})
    joined = keyed.join(bounded(some), keyed["i"].eqNullSafe(some["_i"]) & (keyed["t"] == some["_t"]))
    each = joined.select("i", "t", _lines(F.col("body")).alias("lines"), F.explode("own").alias("x"))
    each = each.select("i", "t", "x.start", "x.n", "x.c", F.array_join(F.slice("lines", F.col("x.start") + 1, F.col("x.n")), "\n").alias("bytes"))
    place = F.struct(F.col("i").isNull().alias("none"), "i", "t", "start")
    owners = each.groupBy("c", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("times")).select("c", F.sha2("bytes", 256).alias("s"), "first", "times")
    marks = each.select("i", "t", "start", "n", "c", F.sha2("bytes", 256).alias("s"))
    lost = spread_join(materialize(marks, "marks"), materialize(owners, "owners"), ["c", "s"], "times").filter(~F.struct("i", "t", "start").eqNullSafe(F.struct("first.i", "first.t", "first.start")))
    return materialize(lost.groupBy("i", "t").agg(F.collect_set(F.struct("start", "n")).alias("cuts")), "removals")


def dedup_lines(docs: DataFrame, long: int = LONG, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row (the document's columns), clean_text, n_lines, n_removed (lines)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col(f"`{key}`").cast("long").alias("i"), F.xxhash64(body).alias("t"), body.alias("body"))
    cuts = removals(keyed, long).withColumnsRenamed({"i": "_i", "t": "_t"})
    rows = docs.select(row, F.col(f"`{key}`").cast("long").alias("i"), F.xxhash64(body).alias("t"), F.col(f"`{text}`").cast("string").alias("body"))
    joined = rows.join(bounded(cuts), rows["i"].eqNullSafe(cuts["_i"]) & (rows["t"] == cuts["_t"]), "left")
    lines = joined.select("row", "body", "cuts", _lines(F.coalesce("body", F.lit(""))).alias("lines"))
    stay = F.filter("lines", lambda x, k: ~F.exists("cuts", lambda r: (k >= r["start"]) & (k < r["start"] + r["n"])))
    lost = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    return lines.select(
        "row",
        F.when(F.col("cuts").isNull(), F.col("body")).otherwise(F.array_join(stay, "\n")).alias("clean_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).alias("n_removed"),
    )
