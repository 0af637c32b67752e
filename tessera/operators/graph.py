"""Directed graphs as edge tables: reachability, chains, cycles, impact, coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import materialize

#: Steps of a frontier between two writes.
HOPS = 4


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes reachable from `start` (node), with their least number of steps, up to `max_depth` if given.

    A frontier moves `HOPS` steps a round by distributed joins until it is empty, however long the paths.
    Edges are written once; each round is written to shared storage with all that was seen before, so
    plans don't grow. Nodes already seen are dropped by an anti join.
    """
    step = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "steps")
    seen = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    done = 0
    while max_depth is None or done < max_depth:
        hops = HOPS if max_depth is None else min(HOPS, max_depth - done)
        layers, current = [], seen.filter(F.col("depth") == done)
        for hop in range(1, hops + 1):
            next_nodes = current.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            current = next_nodes.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(done + hop))
            layers.append(current)
        found = layers[0]
        for layer in layers[1:]:
            found = found.unionByName(layer)
        done += hops
        seen = materialize(seen.unionByName(found).groupBy("node").agg(F.min("depth").alias("depth")), "reached")
        if seen.filter(F.col("depth") == done).isEmpty():
            break
    return seen


def chain(edges: DataFrame, source, target) -> DataFrame:
    """(pos, node): a shortest chain from source to target; of equal ones that with the least nodes in
    order, however long. Empty if there is none."""
    spark = edges.sparkSession
    step = materialize(edges.select("src", "dst").distinct(), "steps")
    kind = edges.schema["src"].dataType.simpleString()
    seen = materialize(spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path")), "chain")
    frontier = seen
    while True:
        hit = frontier.filter(F.col("node") == F.lit(target)).limit(1)
        if not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("pos", "node"))
        new = frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = new.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        frontier = materialize(new, "chain")
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier), "chain")
    return seen.filter("false").select(F.posexplode("path").alias("pos", "node"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, that point at each other: one aggregation over the unordered pair."""
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return pairs.groupBy("a", "b").agg(F.count_distinct("up").alias("ways")).filter("ways = 2").select("a", "b")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """node, dependents (sorted, distinct) and n_imports, repeats included."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("dependents"), F.count("*").alias("n_imports"))


def coupling(edges: DataFrame) -> DataFrame:
    """node, efferent, afferent, instability = efferent / both."""
    out = edges.distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    into = edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    both = out.join(into, "node", "full_outer").select("node", F.coalesce("ce", F.lit(0)).alias("efferent"), F.coalesce("ca", F.lit(0)).alias("afferent"))
    return both.withColumn("instability", F.round(F.col("efferent") / (F.col("efferent") + F.col("afferent")), 4))


def dependency_report(imports: DataFrame) -> DataFrame:
    """src, n_imports, n_local, n_external, n_dependents, n_mutual, coupling of every file of `imports` (src, module, dst, kind, as
    `resolve_imports` gives them) and of every file imported: (0.3 local imports + 0.7 files that import it) by its
    imports, or by one. `n_mutual` counts the imports that are answered by one of the other file.

    Counts per file before any join; dependents and answers are of distinct (src, dst), so a file that all others
    import is one counted row for each of them, pre-aggregated where they are read."""
    own = imports.groupBy("src").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("n_imports", F.lit(True)), ("n_local", F.col("kind") == "local"), ("n_external", F.col("kind") == "third_party"))])
    edges = imports.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n_dependents"))
    # Both ways of a pair of files are one group of two rows.
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    ways = edges.filter("src <> dst").groupBy(low.alias("a"), high.alias("b")).agg(F.sum(F.when(F.col("src") == low, F.col("n"))).alias("up"), F.sum(F.when(F.col("src") == high, F.col("n"))).alias("down"))
    answered = ways.filter("up is not null and down is not null").select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("up").alias("n")), F.struct(F.col("b").alias("src"), F.col("down").alias("n")))).alias("r"))
    mutual = answered.groupBy(F.col("r.src").alias("src")).agg(F.sum("r.n").alias("n_mutual"))
    all_files = own.join(into, "src", "full_outer").join(mutual, "src", "left").na.fill(0)
    score = (0.3 * F.col("n_local") + 0.7 * F.col("n_dependents")) / F.greatest("n_imports", F.lit(1))
    return all_files.select("src", "n_imports", "n_local", "n_external", "n_dependents", "n_mutual", F.round(score, 4).alias("coupling"))


def impact(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(node, depth) of everything that leads to a removed node; the removed ones have depth 0."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), removed)


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, score = twice the dependents plus the imports, and role: entry (no dependents), core (5 or
    more), isolated, inner."""
    c = nodes.join(coupling(edges), "node", "left").na.fill(0, ["efferent", "afferent"])
    role = F.when((F.col("afferent") == 0) & (F.col("efferent") == 0), "isolated").when(F.col("afferent") == 0, "entry").when(F.col("afferent") >= 5, "core").otherwise("inner")
    return c.select("node", (2 * F.col("afferent") + F.col("efferent")).alias("score"), role.alias("role"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, isolated, mean_degree."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    alone = nodes.join(ends, "node", "left_anti").agg(F.count("*").alias("isolated"))
    sizes = nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges"))).join(alone)
    return sizes.withColumn("mean_degree", F.round(F.col("n_edges") / F.col("n_nodes"), 4))


def resolve_imports(imports: DataFrame, files: DataFrame, roots=("", "src/"), builtin=()) -> DataFrame:
    """`imports` (src, module) with dst and kind (builtin, local, third_party).

    A module is looked up as a package or a file below each root and beside the importing file; the
    candidate of the least priority that exists wins. One equi-join on the path.
    """
    dotted = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    here = F.regexp_replace("src", r"[^/]*$", "")
    bases = [F.lit(r) for r in roots] + [here]
    candidates = F.array(*[F.concat(b, dotted, F.lit(end)) for b in bases for end in ("/__init__.py", ".py")])
    numbered = imports.select("src", "module").distinct().select("src", "module", F.posexplode(candidates).alias("priority", "path"))
    hits = numbered.join(files.select("path").distinct(), "path").groupBy("src", "module").agg(F.min_by("path", "priority").alias("dst"))
    top = F.split_part("module", F.lit("."), F.lit(1))
    kind = F.when(top.isin(list(builtin)), "builtin").when(F.col("dst").isNotNull(), "local").otherwise("third_party")
    return imports.join(hits, ["src", "module"], "left").withColumn("kind", kind)
