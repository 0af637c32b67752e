"""Inverted index and relevance search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import split_name, tokens
from tessera.operators.catalog import top_per_group
from tessera.sources.joins import dealt

#: Points of a hit in a name, in a text, and of a partial hit in a name.
POINTS = {"name": 10.0, "doc": 5.0, "partial": 3.0}
TYPE_BOOST = 1.5


def build(entries: DataFrame, key: str, name: str | None, doc: str) -> DataFrame:
    """(token, kind, id): distinct tokens of each entry's name and text."""
    parts = [entries.select(F.explode(F.array_distinct(tokens(F.col(doc)))).alias("token"), F.lit("doc").alias("kind"), F.col(key).alias("id"))]
    if name:
        parts.append(entries.select(F.explode(F.array_distinct(split_name(F.col(name)))).alias("token"), F.lit("name").alias("kind"), F.col(key).alias("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score(index: DataFrame, words: Sequence[str]) -> DataFrame:
    """(id, score): for each word of the query an entry's best hit counts: name, text, partial name.

    The query's words are a filter on the index, so only matching postings are read and shuffled.
    """
    hits = []
    for w in dict.fromkeys(words):
        exact = F.col("token") == w
        partial = (F.col("kind") == "name") & (F.contains("token", F.lit(w)) | F.contains(F.lit(w), F.col("token")))
        points = F.when(exact & (F.col("kind") == "name"), POINTS["name"]).when(exact, POINTS["doc"]).when(partial, POINTS["partial"])
        hits.append(F.when(points.isNotNull(), F.struct(F.lit(w).alias("word"), points.alias("points"))))
    # One pass over the index for all words.
    found = index.select("id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x")).select("id", "x.*")
    best = found.groupBy("id", "word").agg(F.max("points").alias("points"))
    return best.groupBy("id").agg(F.sum("points").alias("score"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count_distinct("id").alias("n_entries"))


#: Queries and rows that are multiplied at a time.
QUERIES, ROWS = 512, 2048


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _first(ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k columns of each row of `cos` by size, then by `ids`, which ascend; in any order."""
    n, m = cos.shape
    if m <= k:
        return np.broadcast_to(ids, cos.shape), cos
    least = np.partition(cos, m - k, axis=1)[:, m - k, None]
    more, same = cos > least, cos == least
    at = np.nonzero(more | (same & (same.cumsum(axis=1) <= k - more.sum(axis=1, keepdims=True))))[1].reshape(n, k)
    return ids[at], np.take_along_axis(cos, at, 1)


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096, by: str | None = None) -> DataFrame:
    """(q, id, cosine, rank): the `k` vectors of `rows` (id, e) nearest to each of `queries` (q, e), but for
    itself; cosine to 6 places, 0 if one has no length, ties by id. With `by`, a column of both, only rows with the query's
    value count (null: none). Queries are broadcast in blocks of about `block`; a task multiplies `QUERIES` of them with `ROWS` rows at a time
    and keeps `k` rows a query, so its memory doesn't grow with the tables. Null vectors take no part; a block's vectors have one length."""
    spark = rows.sparkSession
    group = F.col(by).cast("string") if by else F.lit("")
    rows, queries = rows.withColumn("g", group).filter("e is not null and g is not null"), queries.withColumn("g", group).filter("e is not null and g is not null")
    rows = dealt(rows.select(F.col("id").cast("long"), F.col("e").cast("array<double>"), "g"))
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for i in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).select(F.col("q").cast("long"), F.col("e").cast("array<double>"), "g").toArrow()
        if not some.num_rows:
            continue
        given = some.combine_chunks().to_batches()[0]
        shared = spark.sparkContext.broadcast((given.column("q").to_numpy(), _vectors(given), np.array(given.column("g").to_pylist(), object)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors, groups = shared.value
            lengths, of = np.linalg.norm(vectors, axis=1), {g: np.flatnonzero(groups == g) for g in set(groups)}
            ids, cos = np.full((len(names), k), np.iinfo(np.int64).max), np.full((len(names), k), -np.inf)

            def meet(asked: np.ndarray, own: np.ndarray, part: np.ndarray, sizes: np.ndarray) -> None:
                """Rows with ascending ids against some queries; what can't be among a query's first k is left out early."""
                size = lengths[asked, None] * sizes
                c = np.divide(vectors[asked] @ part.T, size, out=np.zeros_like(size), where=size > 0)
                c[np.isnan(c)] = -np.inf
                left, right = np.searchsorted(own, names[asked], "left"), np.searchsorted(own, names[asked], "right")
                for j in np.flatnonzero(left < right):
                    c[j, left[j] : right[j]] = -np.inf
                may = np.flatnonzero(c.max(axis=1) >= cos[asked].min(axis=1) - 1e-6)
                if len(may):
                    new_ids, new = _first(own, np.round(c[may], 6), k)
                    both_ids, both = np.hstack([ids[asked[may]], new_ids]), np.hstack([cos[asked[may]], new])
                    best = np.lexsort((both_ids, -both))[:, :k]
                    ids[asked[may]], cos[asked[may]] = np.take_along_axis(both_ids, best, 1), np.take_along_axis(both, best, 1)

            for batch in batches:
                if not batch.num_rows:
                    continue
                own, e, held = batch.column("id").to_numpy(zero_copy_only=False), _vectors(batch), np.array(batch.column("g").to_pylist(), object)
                for g in set(held) & of.keys():
                    mine = np.flatnonzero(held == g)
                    mine = mine[np.argsort(own[mine], kind="stable")]
                    for at in range(0, len(mine), ROWS):
                        part = mine[at : at + ROWS]
                        sizes = np.linalg.norm(e[part], axis=1)
                        for begin in range(0, len(of[g]), QUERIES):
                            meet(of[g][begin : begin + QUERIES], own[part], e[part], sizes)
            found = np.isfinite(cos)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], ids.shape)[found]), pa.array(ids[found]), pa.array(cos[found])], ["q", "id", "cosine"])

        parts.append(rows.mapInArrow(work, "q long, id long, cosine double"))
    if not parts:
        return spark.createDataFrame([], "q long, id long, cosine double, rank int")
    return top_per_group(reduce(DataFrame.union, parts), ["q"], [F.col("cosine").desc(), F.col("id")], k)
