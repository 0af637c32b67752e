"""Import cycles of any length: strongly connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.storage import materialize

#: Steps of a colour between two writes.
HOPS = 4


def _degrees(edges: DataFrame) -> DataFrame:
    """(v, ins, outs, u, w): each node's numbers of edges, and one neighbour on each side."""
    ends = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), F.lit(None).cast(edges.schema["dst"].dataType).alias("w"))
    ends = ends.unionByName(edges.select(F.col("src").alias("v"), F.lit(None).cast(edges.schema["src"].dataType).alias("u"), F.col("dst").alias("w")))
    return ends.groupBy("v").agg(F.count("u").alias("ins"), F.count("w").alias("outs"), F.max("u").alias("u"), F.max("w").alias("w"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that touch no node `v` of `gone`."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(gone.select(F.col("v").alias(end)), end, "left_anti").select("src", "dst")
    return out


def _shrunk(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """One round of (edges, bypassed nodes v with u and w). Nodes without an edge in or out are on no
    cycle; those with one edge on both sides are bypassed where no neighbour is in the same round."""
    known = materialize(_degrees(edges), "degrees")
    trivial = known.filter("ins = 0 or outs = 0").select("v")
    rank = F.xxhash64("v", F.lit(salt))
    thin = known.filter("ins = 1 and outs = 1").withColumn("rank", rank)
    near = lambda side: thin.select(F.col("v").alias(side), F.col("rank").alias(f"r{side}"))
    free = lambda side: F.col(f"r{side}").isNull() | (F.struct("rank", "v") < F.struct(F.col(f"r{side}").alias("rank"), F.col(side).alias("v")))
    kept_ends = thin.join(trivial.select(F.col("v").alias("u")), "u", "left_anti").join(trivial.select(F.col("v").alias("w")), "w", "left_anti")
    passed = materialize(kept_ends.join(near("u"), "u", "left").join(near("w"), "w", "left").filter(free("u") & free("w")).select("v", "u", "w"), "bypassed")
    left = _without(edges, trivial.unionByName(passed.select("v"))).unionByName(passed.select(F.col("u").alias("src"), F.col("w").alias("dst")).filter("src <> dst"))
    return materialize(left.distinct(), "shrunk"), passed


def _spread(start: DataFrame, step: DataFrame) -> DataFrame:
    """(v, c): the largest `c` of `start` (v, c) among all nodes that reach v along `step` (src, dst, within).

    Every node has a step to itself, so that a step of all is one join and one grouping and plans grow with the steps, not with their powers.
    Only nodes whose colour the last step raised go on to others, and a write counts them as it runs: no job asks whether all is done."""
    ends = step.select(F.col("src").alias("v")).union(step.select("dst")).union(start.select("v")).distinct()
    loops = ends.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(None).cast(step.schema["within"].dataType).alias("within"), F.lit(True).alias("own"))
    ways = materialize(step.withColumn("own", F.lit(False)).unionByName(loops), "ways")
    now = start.select("v", "c", F.lit(True).alias("moved"))
    while True:
        for _ in range(HOPS):
            going = now.join(ways, F.col("v") == F.col("src")).filter(F.col("own") | (F.col("moved") & (F.col("within").isNull() | (F.col("within") == F.col("c")))))
            raised = going.groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("c"), F.max(F.when(F.col("own"), F.col("c"))).alias("old"))
            now = raised.select("v", "c", F.coalesce(F.col("c") > F.col("old"), F.lit(True)).alias("moved"))
        seen = Observation()
        now = materialize(now.observe(seen, F.count_if("moved").alias("n")), "colours")
        if not seen.get["n"]:
            return now.select("v", "c")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component, size): the nodes on cycles, with the least node of their strongly connected component.

    Nodes that are on no cycle by their edges are trimmed, and chains are bypassed, in rounds that halve a ring or a
    chain of any length. What is left is coloured: every node takes the largest node that reaches it; those
    that reach their colour's node within the colour are its component; then the next colouring. At last the bypassed nodes join, the latest
    first: one lies on the cycles of its neighbours if both are in one component. Self-loops and null ends are dropped;
    repeated edges don't matter; no edges give no rows. Each round is written to shared storage."""
    current = materialize(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null and src <> dst").distinct(), "imports")
    passed, before = [], current.count()
    found = current.select(F.col("src").alias("v"), F.col("src").alias("c")).filter("false")
    salt = 0
    while before:
        current, bypassed = _shrunk(current, salt)
        salt += 1
        passed.append(bypassed)
        now = current.count()
        if now < 0.9 * before:
            before = now
            continue
        if not now:
            break
        nodes = current.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        colours = _spread(nodes.withColumn("c", F.col("v")), current.withColumn("within", F.lit(None).cast(current.schema["src"].dataType)))
        of = lambda end: colours.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
        inside = materialize(current.join(of("src"), "src").join(of("dst"), "dst").filter("csrc = cdst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("csrc").alias("within")), "inside")
        one = _spread(colours.filter("v = c"), inside)
        found = materialize(found.unionByName(one), "strong")
        current = materialize(_without(current, one.select("v")), "imports")
        before = current.count()
    for bypassed in reversed(passed):
        of = lambda end: found.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))  # noqa: B023, E731
        ends = bypassed.join(of("u"), "u", "left").join(of("w"), "w", "left")
        # Neighbours that a round left on no other cycle are alone, unless they are the same node.
        same = F.when(F.col("u") == F.col("w"), F.coalesce("cu", "u")).when(F.col("cu") == F.col("cw"), F.col("cu"))
        joined = ends.select("v", "u", same.alias("c")).filter("c is not null")
        both = joined.select("v", "c").unionByName(joined.filter(F.col("c") == F.col("u")).select(F.col("u").alias("v"), "c"))
        found = materialize(found.unionByName(both).groupBy("v").agg(F.max("c").alias("c")), "strong")
    least = found.groupBy("c").agg(F.min("v").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return found.join(least, "c").select(F.col("v").alias("node"), "component", "size")
