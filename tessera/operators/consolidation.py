"""Consolidation of sibling groups: lookups, group reports, actions, impact and order of work.

Groups are rows, pairs are rows with their group, and every report is a join or an aggregation that
is combined before its shuffle; nothing is gathered on the driver. Ties are broken by the key, so
that results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import affinity_level

#: Mean affinity from which a group's copies go, and from which they are merged.
KEEP_MASTER, MERGE = 0.95, 0.7
SCORE = {"keep_master": 0, "merge": 1, "ignore": 2}


def with_lookup(files: DataFrame, found: DataFrame, key: str, defaults: dict) -> DataFrame:
    """`files` with the columns `defaults` of `found` by key; a file without an entry gets the defaults."""
    right = found.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in defaults])
    out = files.join(right, files[key] == F.col("_k"), "left")
    return out.select(*files.columns, *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def pair_lookup(siblings: DataFrame, pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """`siblings` (columns a, b) with `value` and level of the pair in either direction; 0.0 and `minimal` without one."""
    best = pairs.groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")).agg(F.max(value).alias("_v"))
    on = (F.least(siblings[a], siblings[b]) == F.col("_lo")) & (F.greatest(siblings[a], siblings[b]) == F.col("_hi"))
    out = siblings.join(best, on, "left").select(*siblings.columns, F.coalesce("_v", F.lit(0.0)).alias(value), F.col("_v").isNull().alias("_none"))
    return out.withColumn("level", F.when(F.col("_none"), "minimal").otherwise(affinity_level(F.col(value)))).drop("_none")


def group_report(pairs: DataFrame, group: str, value: str) -> DataFrame:
    """group, n_pairs, avg_affinity (four places), best and worst pair."""
    return pairs.groupBy(group).agg(F.count("*").alias("n_pairs"), F.round(F.avg(value), 4).alias("avg_affinity"), F.max(value).alias("best"), F.min(value).alias("worst"))


def sibling_groups(groups: DataFrame, name: str, suffix: str | None = None, search: str | None = None, min_affinity: float = 0.0, sort: list[Column] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the groups that pass the filters, with `total`, the number of all that do."""
    out = groups.filter(F.col("avg_affinity") >= min_affinity)
    if suffix:
        out = out.filter(F.col(name).endswith(suffix))
    if search:
        out = out.filter(F.contains(F.lower(name), F.lit(search.lower())))
    total = out.agg(F.count("*").alias("total"))
    return out.orderBy(*sort, name).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def in_band(pairs: DataFrame, value: str, low: float, high: float | None = None) -> DataFrame:
    """Pairs with low <= value (< high)."""
    out = pairs.filter(F.col(value) >= low)
    return out if high is None else out.filter(F.col(value) < high)


def proposals_with_siblings(proposals: DataFrame, siblings: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Proposals that have a sibling of the affinity `least`, once each, with the number of such siblings."""
    some = siblings.filter(F.col(value) >= least).groupBy(key).agg(F.count("*").alias("n_siblings"))
    return proposals.join(some, key)


def batch_actions(groups: DataFrame, path: str, never_master: list[str], min_confidence: float = 0.7) -> DataFrame:
    """Adds suggested_action by mean affinity; a master in an excluded path (substring, any case) is left alone."""
    a = F.col("avg_affinity")
    action = F.when(a >= KEEP_MASTER, "keep_master").when(a >= MERGE, "merge").otherwise("ignore")
    hit = F.lit(False)
    for p in never_master:
        hit = hit | F.contains(F.lower(path), F.lit(p.lower()))
    return groups.filter(F.col("confidence") >= min_confidence).withColumn("suggested_action", F.when(hit, "ignore").otherwise(action))


def batch_impact(actions: DataFrame, members: DataFrame, group: str, file: str, size: str, is_master: str) -> DataFrame:
    """One row: groups, files to merge and to delete, bytes to recover, distinct affected files and imports to
    update (estimated as two a file), of `actions` (group, action) over `members`."""
    rows = members.join(actions.select(group, "action"), group)
    merge = F.col("action") == "merge"
    delete = F.col("action").isin("keep_master", "delete_duplicates") & ~F.col(is_master)
    counted = rows.groupBy(file).agg(F.sum(merge.cast("long")).alias("m"), F.sum(delete.cast("long")).alias("d"), F.sum(F.when(delete, F.col(size)).otherwise(0)).alias("s"))
    out = counted.agg(F.sum("m").alias("files_to_merge"), F.sum("d").alias("files_to_delete"), F.sum("s").alias("bytes_to_recover"), F.sum((F.col("m") + F.col("d") > 0).cast("long")).alias("affected_files"))
    total = actions.agg(F.count("*").alias("total_groups"))
    return total.crossJoin(out).withColumn("imports_to_update", 2 * F.col("affected_files"))


def version_pivot(files: DataFrame, path: str, project: str, digest: str) -> DataFrame:
    """path, versions (project -> hash; of several the greatest), n_projects, n_versions: paths in several projects
    with more than one content, the most divergent first."""
    one = files.groupBy(path, project).agg(F.max(digest).alias("_h"))
    out = one.groupBy(path).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(project, "_h")))).alias("versions"), F.countDistinct("_h").alias("n_versions"))
    out = out.withColumn("n_projects", F.size("versions")).filter("n_projects > 1 and n_versions > 1")
    return out.orderBy(F.desc("n_versions"), F.desc("n_projects"), path)


def keepers(files: DataFrame, group: str, path: str, size: str, suffixed: Column) -> DataFrame:
    """The file of each group that stays: names without a copy suffix first, then the largest, then the shortest
    and least path. With n_files and the bytes of the others."""
    pick = F.struct((~suffixed).alias("plain"), F.col(size).alias("s"), (-F.length(path)).alias("l"))
    ranked = files.groupBy(group).agg(F.max(pick).alias("m"), F.count("*").alias("n_files"), F.sum(size).alias("bytes"))
    best = files.join(ranked, group).filter((~suffixed == F.col("m.plain")) & (F.col(size) == F.col("m.s")) & (-F.length(path) == F.col("m.l")))
    return best.groupBy(group, "n_files", "bytes").agg(F.min(path).alias("keeper"), F.max(size).alias("kept")).select(group, "keeper", "n_files", (F.col("bytes") - F.col("kept")).alias("bytes_saved"))


def replacements(originals: DataFrame, candidates: DataFrame, name: str, size: str, least: int = 500, share: float = 0.5) -> DataFrame:
    """Originals smaller than `share` of the largest candidate of their name, if that is over `least` bytes."""
    best = candidates.groupBy(name).agg(F.max(size).alias("best"))
    return originals.join(best, name).filter((F.col("best") > least) & (F.col(size) < share * F.col("best")))


def test_presence(files: DataFrame, path: str) -> DataFrame:
    """Adds has_tests: the name is a test's, or one of four derived test files is there."""
    name = F.substring_index(path, "/", -1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    near = [F.concat(folder, p, F.lit("test_"), stem, F.lit(".py")) for p in (F.lit(""), F.lit("tests/"))] + [F.concat(folder, p, stem, F.lit("_test.py")) for p in (F.lit(""), F.lit("tests/"))]
    known = files.select(F.col(path).alias("_t")).distinct()
    wanted = files.select(F.col(path).alias("_p"), F.explode(F.array(*near)).alias("_t")).distinct()
    found = wanted.join(known, "_t", "left_semi").select("_p").distinct()
    own = name.rlike(r"^test_.*|.*_test\.py$|^tests?\.py$")
    return files.join(found, files[path] == F.col("_p"), "left").select(*files.columns, (own | F.col("_p").isNotNull()).alias("has_tests"))


def category(path: Column, rules: list[tuple[list[str], str]], other: str) -> Column:
    """The folder of the first rule that has a part inside the lower-cased path."""
    out = F.lit(other)
    for parts, folder in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.lower(path), F.lit(p))
        out = F.when(hit, folder).otherwise(out)
    return out


def folder_patterns(files: DataFrame, path: str) -> DataFrame:
    """part, n: how often each folder name stands in the paths."""
    parts = F.split(path, "/")
    return files.select(F.explode(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def version_ranks(files: DataFrame, group: str, score: Column, path: str) -> DataFrame:
    """Each group's quality ranks, and the confidence in the first by its lead (50 points are sure; alone 0.8)."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), path)
    out = files.withColumn("score", score).withColumns({"position": F.row_number().over(w), "_next": F.lead("score").over(w)})
    lead = F.round(F.least(0.5 + (F.col("score") - F.col("_next")) / 50, F.lit(1.0)), 2)
    return out.withColumn("confidence", F.when(F.col("position") == 1, F.coalesce(lead, F.lit(0.8)))).drop("_next")
