"""Comparison of two projects: files by name and likeness, functions by name, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard
from tessera.sources.joins import dealt, parts, spread_join
from tessera.sources.storage import materialize, scratch


def line_set(text: Column) -> Column:
    return F.array_distinct(F.split(text, "\n", -1))


def common_lines(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(line_set(a), line_set(b)))


def line_differences(a: Column, b: Column, n: int = 3) -> Column:
    """The first n lines, in order, that only a has, then those that only b has, marked `-` and `+`."""
    only = lambda x, y, mark: F.transform(F.slice(F.array_sort(F.array_except(line_set(x), line_set(y))), 1, n), lambda s: F.concat(F.lit(mark), s))
    return F.concat(only(a, b, "- "), only(b, a, "+ "))


def same_named(left: DataFrame, right: DataFrame, name: str, path: str, text: str, likeness, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity, match_type, common_lines, differences) of files of one name in both projects with unequal
    texts. Files of one name are those of two trees, so a name brings few pairs; equal texts meet by hash
    elsewhere."""
    x = left.select(F.col(name).alias("_n"), F.col(path).alias("a"), F.col(text).alias("ta"))
    y = right.select(F.col(name).alias("_n"), F.col(path).alias("b"), F.col(text).alias("tb"))
    out = x.join(y, "_n").filter("ta <> tb").withColumn("similarity", F.round(likeness(F.col("ta"), F.col("tb")), 4)).filter(F.col("similarity") >= threshold)
    kind = F.when(F.col("similarity") >= 0.9, "similar").otherwise("partial")
    return out.select("a", "b", "similarity", kind.alias("match_type"), common_lines(F.col("ta"), F.col("tb")).alias("common_lines"), line_differences(F.col("ta"), F.col("tb")).alias("differences"))


def args_likeness(a: Column, b: Column) -> Column:
    """Jaccard of two functions' arguments; without any, 1 if both have none, else 0.5."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.5)).otherwise(jaccard(a, b))


def function_score(hash_a: Column, hash_b: Column, args: Column, lines_a: Column, lines_b: Column) -> Column:
    """1 for equal sources, else the mean of the arguments' likeness `args` and the lengths'."""
    size = 1 - F.abs(lines_a - lines_b) / F.greatest(lines_a, lines_b, F.lit(1))
    return F.when(hash_a == hash_b, 1.0).otherwise((args + size) / 2)


#: Members of a kind that stand in one row, about.
MEMBERS = 500
#: Cells of all names for each part of the join, about; functions of one side in a cell, about, at most.
CELLS, SIDE = 8, 50_000


def function_matches(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(name, a, b, score) of functions (name, path, hash, args, lines) of one name in both projects.

    Functions equal in name, hash, args and lines are of one kind. Kinds are scored, not functions, with their members in rows of about
    `MEMBERS`. A name's pairs are cut into a grid of cells: a row of the left stands in one line of cells, a row of the right in one
    column. Cells are dealt out, and there kinds of equal args are gathered, so that args are compared once, and pairs are scored and
    unfold. What is shuffled and written are functions, once for each cell that they stand in, and no pairs. How many cells there are
    depends on the tasks, and only beyond `SIDE` on the functions."""
    spark, what = left.sparkSession, ["name", "hash", "args", "lines"]

    def kinds(side: DataFrame, members: str) -> DataFrame:
        """The kinds of a side, a row for each part of their members."""
        with scratch(spark):
            rows = materialize(side.filter("name is not null").select("path", *what, F.md5(F.to_json(F.struct(*what))).alias("kind")), "functions")
            each = materialize(rows.groupBy("kind").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "kinds")
            part = F.pmod(F.xxhash64("path"), F.col("parts")).alias("part")
            return materialize(spread_join(rows, each, ["kind"]).groupBy(*what, part).agg(F.collect_list("path").alias(members)), "members", keep=True).drop("part")

    def placed(rows: DataFrame, members: str, mine: str, other: str) -> DataFrame:
        """The kinds of equal args in each cell of their name: a row stands in one of `mine`, and there in all of `other`."""
        at = F.pmod(F.xxhash64("hash", "args", "lines", F.col(members)[0]), F.col(mine)).alias(mine)
        all_of = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)
        cells = dealt(spread_join(rows, names, ["name"]).select(*what, members, at, all_of), "name", "i", "j")
        return cells.groupBy("name", "i", "j", F.col("args").alias(f"{members}_args")).agg(F.collect_list(F.struct("hash", "lines", members)).alias(f"{members}_kinds"))

    x, y = kinds(left, "mine"), kinds(right, "theirs")
    count = lambda rows, members, n: rows.groupBy("name").agg(F.sum(F.size(members)).alias(n))
    lines = lambda n, m: F.greatest(F.lit(1), F.least(n, F.ceil(F.greatest(F.least(F.sqrt(cells * n / m), cells), n / SIDE))))
    with scratch(spark):
        both = materialize(count(x, "mine", "nx").join(count(y, "theirs", "ny"), "name"), "names")
        total = both.agg(F.sum(F.col("nx").cast("double") * F.col("ny"))).first()[0] or 1.0
        cells = CELLS * parts(spark) / total * F.col("nx") * F.col("ny")
        names = materialize(both.select("name", lines(F.col("nx"), F.col("ny")).alias("i"), lines(F.col("ny"), F.col("nx")).alias("j")), "names", keep=True)
    likeness = args_likeness(F.col("mine_args"), F.col("theirs_args")).alias("args")
    met = placed(x, "mine", "i", "j").join(placed(y, "theirs", "j", "i"), ["name", "i", "j"]).select("name", likeness, F.explode("mine_kinds").alias("x"), "theirs_kinds")
    score = function_score(F.col("x.hash"), F.col("y.hash"), F.col("args"), F.col("x.lines"), F.col("y.lines"))
    near = met.select("name", "args", "x", F.explode("theirs_kinds").alias("y")).filter(score >= threshold - 1e-4)  # rounding costs more than the score
    found = near.select("name", "x.mine", "y.theirs", F.round(score, 4).alias("score")).filter(F.col("score") >= threshold)
    return found.select("name", F.explode("mine").alias("a"), "theirs", "score").select("name", "a", F.explode("theirs").alias("b"), "score")
