"""Impact of deleting, merging and moving files, over import edges (src imports dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.joins import spread_join
from tessera.sources.storage import materialize

#: Fixed value: import changes from which a group isn't merged without review.
MANY_CHANGES = 10


def deletion_order(edges: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """file, internal, external, score, position: the files to delete, least needed first. A dependent among them
    counts ten, another one."""
    wanted = files.select(F.col(file).alias("_f")).distinct()
    own = edges.select("src", "dst").distinct().join(wanted, F.col("dst") == F.col("_f")).drop("_f")
    inside = own.join(wanted, F.col("src") == F.col("_f"), "left").groupBy("dst").agg(
        F.sum(F.col("_f").isNotNull().cast("long")).alias("internal"), F.sum(F.col("_f").isNull().cast("long")).alias("external")
    )
    out = wanted.join(inside, F.col("_f") == F.col("dst"), "left").select(F.col("_f").alias(file), F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external"))
    return out.withColumn("score", F.col("internal") * 10 + F.col("external")).orderBy("score", file)


def import_lines(edges: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """dst, src, lines: where dependents import each target."""
    wanted = targets.select(F.col(target).alias("_t")).distinct()
    return edges.join(wanted, F.col("dst") == F.col("_t")).groupBy("dst", "src").agg(F.array_sort(F.collect_set("lineno")).alias("lines"))


def group_impact(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, n_files, n_affected, n_changes, safe of `groups` (group_id, file, is_master): dependents outside of
    the group, and their import lines that must point to the master."""
    of_dst = groups.select(F.col("group_id"), F.col("file").alias("dst"), "is_master")
    of_src = groups.select(F.col("group_id").alias("_g"), F.col("file").alias("_s"))
    used = edges.join(of_dst, "dst")
    outside = used.join(of_src, (used["group_id"] == F.col("_g")) & (used["src"] == F.col("_s")), "left_anti")
    by_src = outside.groupBy("group_id", "src").agg(F.sum((~F.col("is_master")).cast("long")).alias("changes"))
    found = by_src.groupBy("group_id").agg(F.count("*").alias("n_affected"), F.sum("changes").alias("n_changes"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n_files"))
    out = sizes.join(found, "group_id", "left").na.fill(0, ["n_affected", "n_changes"])
    return out.withColumn("safe", F.col("n_changes") <= MANY_CHANGES)


def merge_impact(edges: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """src, n_rewrites: files outside of the merged ones that import them, with the import lines to rewrite."""
    wanted = files.select(F.col(file).alias("_f")).distinct()
    return edges.join(wanted, F.col("dst") == F.col("_f"), "left_semi").join(wanted, F.col("src") == F.col("_f"), "left_anti").groupBy("src").agg(F.count("*").alias("n_rewrites"))


def stem_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) by the last part of the module and the file's stem, a file to itself left out."""
    last = imports.select(F.col("path").alias("src"), F.substring_index("module", ".", -1).alias("stem"))
    stems = files.select(F.col("path").alias("dst"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("stem"))
    return last.join(stems, "stem").filter("src <> dst").select("src", "dst").distinct()


def first_path_match(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, dst): the first file, by id, whose path holds the module as folders. Instead of a comparison
    of all with all, files stand under each run of their path's parts and the module's is looked up;
    parts match whole."""
    parts = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    n = F.size("parts")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice("parts", i, j - i + 1), "/"))))
    # Least ids are kept in hash tables, which texts can't be; each path stands in the index once.
    once = materialize(files.groupBy("path").agg(F.min("id").alias("id")), "paths")
    index = once.select("id", F.col("path").alias("dst"), parts.alias("parts")).select("id", "dst", F.explode(F.array_distinct(runs)).alias("run"))
    least = index.groupBy("run").agg(F.min("id").alias("id"))
    first = materialize(index.join(least, ["run", "id"]).groupBy("run").agg(F.min("dst").alias("dst")), "first")
    return spread_join(imports.withColumn("run", F.translate("module", ".", "/")), first, ["run"]).select("path", "module", "dst")


def folded(path: Column) -> Column:
    """The path without `.`, empty parts, and parts that a `..` takes back; a `..` beyond the root goes."""
    back = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, part: F.when(part == "..", back(done)).when(part.isin(".", ""), done).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_js(imports: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("", ".js", ".jsx", ".ts", ".tsx", "/index.js")) -> DataFrame:
    """(path, module, kind, resolved) of JavaScript imports: relative (`.`, `..`) and `@/` (below src) modules are
    tried with each suffix in order; one that isn't found is local all the same; all others are third party."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    target = F.when(F.col("module").startswith("@/"), folded(F.concat(F.lit("src/"), F.substring("module", 3, 10_000))))
    target = target.when(F.col("module").startswith("."), folded(F.concat_ws("/", folder, "module")))
    rows = imports.withColumn("_base", target)
    tried = rows.filter("_base is not null").select("path", "module", F.posexplode(F.array(*[F.concat("_base", F.lit(s)) for s in suffixes])).alias("rank", "candidate"))
    known = files.select(F.col("path").alias("candidate")).distinct()
    best = tried.join(known, "candidate").groupBy("path", "module").agg(F.min_by("candidate", "rank").alias("resolved"))
    kind = F.when(F.col("_base").isNull(), "third_party").otherwise("local")
    return rows.withColumn("kind", kind).join(best, ["path", "module"], "left").select("path", "module", "kind", "resolved")


def dependents_by_name(imports: DataFrame, stem: str, own: Column) -> DataFrame:
    """Distinct paths whose module or imported names hold the stem, the file itself left out."""
    hit = F.contains("module", F.lit(stem)) | F.exists("names", lambda x: F.contains(x, F.lit(stem)))
    return imports.filter(hit & ~own).select("path").distinct()


def ranked_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")
