"""Writes of the catalog as table states: new rows with dense ids, children of a parse, cascades, histories.

A catalog table is a Parquet folder; a write gives its next state, which is written beside the old one and
takes its place. Ids are the next numbers after the largest, given by range partitions and prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The child tables of a parsed file, by the kind of their rows.
CHILDREN = {"functions": "function", "classes": "class", "variables": "write", "imports": "import", "data_flow": "read"}


def insert(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`table` with `rows` after it; new ids go on from the largest one, in the given order.

    Numbers come from counts per partition of a range partitioning, so no task sees all rows."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    bases = counts.withColumn("_base", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_base")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    numbered = ranged.withColumn("_i", local).join(F.broadcast(bases), "_p").crossJoin(F.broadcast(top))
    new = numbered.withColumn(key, F.col("_top") + F.col("_base") + F.col("_i"))
    return table.unionByName(new.select(*table.columns))


def children(entities: DataFrame) -> dict[str, DataFrame]:
    """The child tables of parsed files, from their entity rows in one pass each."""
    return {name: entities.filter(F.col("kind") == kind) for name, kind in CHILDREN.items()}


def cascade(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str]], root: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows `gone` (column `key`) of `root` and what hangs on them. `parents`: table -> (parent
    table, the column with its id), parents first; every table's own id is the column `id`."""
    lost = {root: gone.select(F.col(key).alias("_id")).distinct()}
    out = {root: tables[root].join(lost[root], tables[root]["id"] == F.col("_id"), "left_anti")}
    for name, (parent, column) in parents.items():
        t = tables[name]
        lost[name] = t.join(lost[parent], t[column] == F.col("_id"), "left_semi").select(F.col("id").alias("_id"))
        out[name] = t.join(lost[parent], t[column] == F.col("_id"), "left_anti")
    return out


def history(log: DataFrame, path: str, at: str, action: str) -> DataFrame:
    """path, use_count, last_used, favourite from a log of `open`, `toggle` and `remove` entries: uses are counted since
    the last removal, each toggle turns the favourite over, and a path whose last entry removes it is gone."""
    cut = F.max(F.when(F.col(action) == "remove", F.col(at))).over(Window.partitionBy(path))
    live = log.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col(at) > F.col("_cut")))
    n = lambda a: F.sum((F.col(action) == a).cast("long"))
    out = live.groupBy(path).agg(n("open").alias("use_count"), F.max(at).alias("last_used"), (n("toggle") % 2 == 1).alias("favourite"))
    return out.filter("use_count > 0")


def proposals(groups: DataFrame, members: DataFrame, key: str, file: str, master: str, affinity: Column) -> tuple[DataFrame, DataFrame]:
    """(proposal rows, sibling rows): one row per group, and one for each member besides the master with its affinity."""
    rows = members.join(groups.select(key, F.col(master).alias("_m")), key)
    siblings = rows.filter(F.col(file) != F.col("_m")).select(key, file, affinity.alias("affinity_to_master"))
    sizes = siblings.groupBy(key).agg(F.count("*").alias("sibling_count"))
    return groups.join(sizes, key, "left").na.fill(0, ["sibling_count"]), siblings
