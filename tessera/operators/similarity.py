"""Similarity of texts and of files: pairs are blocked by an equi-join before they are compared."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import affinity_level, jaccard, mean_of

#: Weights of content, structure and data-flow similarity.
WEIGHTS = {"content": 0.4, "structure": 0.3, "dna": 0.3}


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts as `difflib` computes it; it depends on the order of the two.
    Both empty: 1, one empty: 0, null: null; equal texts (1) aren't matched, and a pair that a batch repeats is matched once.
    Arrow batches; whole-text matching has no JVM form."""
    known: dict[tuple[str, str], float] = {}

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x or not y or x == y:
            return float(x == y)
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def changed_lines(a: pd.Series, b: pd.Series) -> pd.Series:
    """Lines that an edit from one text to the other replaces, deletes or inserts."""

    def one(x: str | None, y: str | None) -> int:
        ops = SequenceMatcher(None, (x or "").splitlines(), (y or "").splitlines()).get_opcodes()
        return sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in ops if op != "equal")

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def group_pairs(files: DataFrame, group: str, key: str, cap: int | None = None) -> DataFrame:
    """Pairs x, y (structs) of files of one group, x before y by key. `cap` is the operator's stated
    limit of compared pairs per group: ranks i < j are kept while j(j-1)/2 + i stays below it, so at
    most about sqrt(2 cap) rows of a group take part and no group is ever expanded in full."""
    ranked = files.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1)
    if cap is not None:
        ranked = ranked.filter(F.col("_rank") * (F.col("_rank") - 1) / 2 < cap)
    x = ranked.select(F.col(group).alias("_g"), F.struct(*files.columns).alias("x"), F.col("_rank").alias("_i"))
    y = ranked.select(F.col(group).alias("_h"), F.struct(*files.columns).alias("y"), F.col("_rank").alias("_j"))
    on = (F.col("_g") == F.col("_h")) & (F.col("_i") < F.col("_j"))
    if cap is not None:
        on = on & (F.col("_j") * (F.col("_j") - 1) / 2 + F.col("_i") < cap)
    return x.join(y, on).select("x", "y")


def master_pairs(files: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs x, m (structs): every file but the master with its group's master, the one of the least key.
    Linear in the files; the master is an aggregate, so a group of any size is combined first."""
    whole = F.struct(*files.columns)
    masters = files.groupBy(F.col(group).alias("_g")).agg(F.min_by(whole, key).alias("m"))
    return files.select(F.col(group).alias("_h"), whole.alias("x")).join(masters, F.col("_h") == F.col("_g")).filter(F.col(f"x.{key}") != F.col(f"m.{key}")).select("x", "m")


def structure_similarity(x: str, y: str, fields=("functions", "classes", "imports")) -> Column:
    """Mean Jaccard of the name sets that one side has; 0.5 if no side has any."""
    return F.coalesce(mean_of(*[jaccard(F.col(f"{x}.{f}"), F.col(f"{y}.{f}")) for f in fields]), F.lit(0.5))


def dna_similarity(x: str, y: str) -> Column:
    """Mean of complexity ratio, Jaccard of variables and equal first 8 characters of the fingerprints;
    0.5 if one side has none."""
    a, b = F.col(f"{x}.complexity"), F.col(f"{y}.complexity")
    ratio = F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b))
    same = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda s, i: s + (F.substr(f"{x}.fingerprint", i, F.lit(1)) == F.substr(f"{y}.fingerprint", i, F.lit(1))).cast("double")) / 8
    known = F.col(f"{x}.fingerprint").isNotNull() & F.col(f"{y}.fingerprint").isNotNull()
    return F.when(known, F.coalesce(mean_of(ratio, jaccard(F.col(f"{x}.variables"), F.col(f"{y}.variables")), same), F.lit(0.5))).otherwise(0.5)


def affinity(pairs: DataFrame, weights=None) -> DataFrame:
    """content, structure, dna, overall (4 places) and level of each pair of structs with text, hash,
    functions, classes, imports, variables, complexity, fingerprint.

    Pairs of equal content skip the text comparison: they are split off first, since a Python
    function under a condition would run for all rows.
    """
    w = weights or WEIGHTS
    same = F.col("x.hash").eqNullSafe(F.col("y.hash")) & F.col("x.hash").isNotNull()
    equal = pairs.filter(same).select("x", "y", *[F.lit(1.0).alias(k) for k in w])
    other = pairs.filter(~same).select(
        "x", "y", sequence_ratio(F.col("x.text"), F.col("y.text")).alias("content"), structure_similarity("x", "y").alias("structure"), dna_similarity("x", "y").alias("dna")
    )
    total = sum((v * F.coalesce(F.col(k), F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    both = equal.unionByName(other).withColumn("_total", total)
    return both.withColumns({"overall": F.round("_total", 4), "level": affinity_level(F.col("_total"))}).drop("_total")


def name_similarity(a: Column, b: Column, a_tokens: Column, b_tokens: Column, ratio: Column) -> Column:
    """1 if equal; else the larger of the Jaccard of the names' parts and the ratio of the names."""
    return F.when(a == b, 1.0).otherwise(F.greatest(F.coalesce(jaccard(a_tokens, b_tokens), F.lit(0.0)), ratio))


def exact_matches(a: DataFrame, b: DataFrame, content: str = "hash") -> DataFrame:
    """Pairs of files of two projects with equal content: every left file with the count and least key
    of the right ones, so that common content makes no product."""
    right = b.groupBy(content).agg(F.count("*").alias("n_right"), F.min("key").alias("right_key"))
    return a.join(right, content).select(F.col("key").alias("left_key"), "right_key", "n_right", content)


def contained_in(rows: DataFrame, text: str, queries: DataFrame, query: str, size: int = 8) -> DataFrame:
    """(row key, query key, share): share of a query's distinct `size`-word shingles in a row's text, for
    pairs with one at least. `rows` and `queries` have (key, text). The join is on shingle hashes."""

    def shingles(df: DataFrame, column: str, name: str) -> DataFrame:
        words = F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")
        spread = df.select(F.col("key").alias(name), words.alias("w")).filter(F.size("w") >= size)
        grams = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(size)]))
        return spread.select(name, F.explode(F.array_distinct(grams)).alias("g"))

    q = shingles(queries, query, "query_key")
    sizes = q.groupBy("query_key").agg(F.count("*").alias("n"))
    hits = shingles(rows, text, "row_key").join(q, "g").groupBy("row_key", "query_key").agg(F.count("*").alias("found"))
    return hits.join(sizes, "query_key").select("row_key", "query_key", F.round(F.col("found") / F.col("n"), 4).alias("share"))
