"""Learning from past decisions: votes, common choices, consistency, feature similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import top_per_group


def feature_similarity(a: str, b: str, numeric: Sequence[str], flags: Sequence[str]) -> Column:
    """Share of the features that match: numbers within a fifth of the larger magnitude (1 at least),
    flags if equal. Features that are null on a side don't count."""
    known, match = F.lit(0), F.lit(0)
    for f in [*numeric, *flags]:
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        both = x.isNotNull() & y.isNotNull()
        same = F.abs(x - y) <= 0.2 * F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) if f in numeric else x == y
        known, match = known + both.cast("int"), match + (both & same).cast("int")
    return F.when(known > 0, match / known).otherwise(0.0)


def weighted_vote(candidates: DataFrame, query: str, choice: str, similarity: str, tie: str, n: int = 10) -> DataFrame:
    """query, choice, weight, confidence (share of all weight) of the choice with the most similarity
    among each query's n most similar past decisions."""
    top = top_per_group(candidates, [query], [F.col(similarity).desc(), F.col(tie)], n)
    sums = top.groupBy(query, choice).agg(F.sum(similarity).alias("weight"))
    best = sums.groupBy(query).agg(F.max(F.struct("weight", choice)).alias("m"), F.sum("weight").alias("total"))
    return best.select(query, F.col(f"m.{choice}").alias(choice), F.col("m.weight").alias("weight"), (F.col("m.weight") / F.col("total")).alias("confidence"))


def common_choices(decisions: DataFrame, kind: str, choice: str, n: int = 3) -> DataFrame:
    """kind, choice, n, share, rank: each kind's n most frequent choices."""
    counted = decisions.groupBy(kind, choice).agg(F.count("*").alias("n"))
    totals = counted.groupBy(kind).agg(F.sum("n").alias("total"))
    ranked = top_per_group(counted.join(totals, kind), [kind], [F.col("n").desc(), F.col(choice)], n)
    return ranked.select(kind, choice, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "rank")
