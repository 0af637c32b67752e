"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.joins import spread_join
from tessera.sources.storage import materialize

#: Edges from which a hub's are spread over tasks; fewer fit into one.
MANY = 100_000


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours. Pre-aggregated before the shuffle."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    return both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).select("u", F.least("u", "least").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node with an edge, and the least node that it reaches.

    Every round links a node's larger neighbours to its least neighbour (large star), then its
    smaller neighbours to the least (small star); rounds grow with the logarithm of the longest
    path. The edges of a hub are spread over tasks (`spread_join`) if there are `MANY`. Each round is written to shared storage, which cuts the lineage. Repeated edges don't
    matter; self-loops and null ends are dropped; no edges give no rows. `node` and `component` have
    the type of the ends.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    current = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda: tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state()
    if not before[0]:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        minima = _minima(current).withColumnRenamed("u", "a")
        large = (spread_join(both, materialize(minima, "minima"), ["a"]) if before[0] >= MANY else both.join(minima, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.filter("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.filter("a <> b").join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
        current = materialize(small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def unsettled(listed: DataFrame, found: DataFrame, node: str, key: list[str]) -> DataFrame:
    """The rows of the lists under `key` whose nodes are in more than one component of `found`, with their
    `component` and the list's largest one, `major`."""
    placed = materialize(listed.join(found, listed[node] == found["node"], "left").select(*listed.columns, F.coalesce("component", node).alias("component")), "placed")
    held = placed.groupBy(*key, "component").agg(F.count("*").alias("held"))
    parts = held.groupBy(*key).agg(F.max(F.struct("held", "component")).alias("m"), F.count("*").alias("parts"), F.sum("held").alias("members")).filter("parts > 1")
    parts = materialize(parts.select(*key, F.col("m.component").alias("major"), "members"), "parts")
    return materialize(spread_join(placed, parts, key, "members").drop("members"), "unsettled")


#: Members of an unsettled list that a task pairs with the others at a time; hubs beyond the first; pairs for each member
#: that need no further hub.
BLOCK, STARS, FEW = 256, 1, 64


def open_pairs(split: DataFrame, node: str, key: list[str], may: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(a, b, lists): the pairs of unsettled lists in different components, those of a list's largest component
    among themselves left out, and in how many lists they meet. A long list is cut into blocks of about `BLOCK` members outside that component; each
    block meets the whole list in tasks of its own. `may`, given the aliases of both sides, is a condition on their columns that every
    true pair meets; other pairs don't leave the join."""
    few = split.filter("component <> major").groupBy(*key).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    cut = materialize(spread_join(split, materialize(few, "blocks"), key), "cut")
    x = cut.filter("component <> major").withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")).alias("x")
    y = cut.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    on = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col(f"x.{node}") < F.col(f"y.{node}")))
    for k in (*key, "block"):
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    if may is not None:
        on = on & may("x", "y")
    return x.join(y, on).select(F.least(f"x.{node}", f"y.{node}").alias("a"), F.greatest(f"x.{node}", f"y.{node}").alias("b")).groupBy("a", "b").agg(F.count("*").alias("lists"))


def further_stars(links: DataFrame, split: DataFrame, node: str, key: list[str], verified, most: int = STARS) -> tuple[DataFrame, DataFrame]:
    """`links` with those of further hubs, and what is unsettled after them.

    While the unsettled lists `split` hold over `FEW` times as many pairs as members, the least node outside each list's
    largest component is its next hub and meets all members of other components, which adds as many pairs as members. Nodes that have
    been hubs of a list have met all of it and leave it."""
    for _ in range(most):
        each = split.groupBy(*key).agg(F.count("*").alias("members"), F.sum((F.col("component") != F.col("major")).cast("long")).alias("outside"), F.min(F.when(F.col("component") != F.col("major"), F.struct(node, "component"))).alias("hub"))
        hubs = materialize(each, "hubs")
        members, pairs = hubs.agg(F.sum("members"), F.sum(F.col("members") * F.col("outside"))).first()
        if not members or pairs <= FEW * members:
            break
        met = materialize(spread_join(split, hubs.select(*key, "hub", "members"), key, "members"), "met")
        other = met.filter(F.col("component") != F.col("hub.component")).select(F.least(F.col(f"hub.{node}"), node).alias("a"), F.greatest(F.col(f"hub.{node}"), node).alias("b")).distinct()
        links = materialize(links.unionByName(verified(other)), "links")
        left = met.filter(F.col(node) != F.col(f"hub.{node}")).drop("hub", "members", "component", "major")
        split = unsettled(left, components(links), node, key)
    return links, split


def settle(lists: DataFrame, node: str, key: list[str], verified) -> DataFrame:
    """Links (a, b, and what `verified` adds) whose components are those of all true pairs of nodes that share a list.

    `verified` keeps the true ones of pairs (a, b). Every list's nodes are compared with its least node first, then
    the pairs that are still in different components are; lists of any length lose no group."""
    hubs = materialize(lists.groupBy(*key).agg(F.min(node).alias("_hub"), F.count("*").alias("_members")).filter("_members > 1"), "hubs")
    listed = materialize(spread_join(lists, hubs, key, "_members").select(node, *key, "_hub"), "lists")
    stars = listed.filter(F.col(node) != F.col("_hub")).select(F.col("_hub").alias("a"), F.col(node).alias("b")).distinct()
    links = materialize(verified(stars), "links")
    links, split = further_stars(links, unsettled(listed.drop("_hub"), components(links), node, key), node, key, verified)
    return links.unionByName(materialize(verified(open_pairs(split, node, key).select("a", "b")), "links"))
