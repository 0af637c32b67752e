"""Sharding (10): a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..n-1 in the order of (key, CRC of the text, size); the permutation
sends number i to p(i), and shard = p(i) mod shards, slot = p(i) div shards. The law is `rows`:
counts differ by one at most, slots have no gaps, and both can be computed from the number alone,
forwards and backwards.

Cases: a null text has size 1 and CRC 0; rows equal in key, CRC and size are interchangeable, so
their order is free; null keys come first; an empty table gives no rows; of a very long text only size and
CRC are shuffled; columns besides the two named aren't read, clashing names included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import materialize

ROUNDS = 6
SEED = 20240229


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer of multiplications and shifts, keyed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed + r * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64), 0)[0]) for r in range(ROUNDS)]


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    low = bits // 2
    sizes = [(low, bits - low) if r % 2 == 0 else (bits - low, low) for r in range(len(keys))]
    # A round of widths (a, b): x = left(a) | right(b) becomes right(b) | left ^ f(right)(a).
    for r in range(len(keys))[:: -1 if back else 1]:
        a, b = sizes[r]
        mask_a, mask_b = np.uint64((1 << a) - 1), np.uint64((1 << b) - 1)
        if back:
            right, mixed = x >> np.uint64(a), x & mask_a
            x = ((mixed ^ (_mix(right, keys[r]) & mask_a)) << np.uint64(b)) | right
        else:
            left, right = x >> np.uint64(b), x & mask_b
            x = (right << np.uint64(a)) | (left ^ (_mix(right, keys[r]) & mask_a))
    return x


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at `numbers`. The Feistel network runs over the
    next power of two; values of n and more walk on along their cycle, under two steps on average."""
    x, bits, keys = numbers.astype(np.uint64), max(2, (n - 1).bit_length()), _keys(seed)
    x = _once(x, bits, keys, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _once(x[out], bits, keys, back)
    return x.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], partitions: int) -> tuple[DataFrame, int]:
    """(`rows` with `row_no`, how many): 0..n-1 in the given order. A range partitioning sorts, each
    partition numbers its own rows, and a prefix sum over the partitions' counts gives the rest."""
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    pid = F.shiftright(F.monotonically_increasing_id(), 33)
    fixed = materialize(ranged.withColumns({"_mono": F.monotonically_increasing_id(), "_pid": pid}), "rownumbers")
    counts = sorted(fixed.groupBy("_pid").count().collect())
    ends = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    bases = rows.sparkSession.createDataFrame([(r["_pid"], e) for r, e in zip(counts, ends, strict=False)], "_pid long, _base long")
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.join(F.broadcast(bases), "_pid").withColumn("row_no", F.col("_base") + local).drop("_pid", "_mono", "_base"), ends[-1]


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard, slot. Texts stay where they are read: only key, size
    and CRC are shuffled, by ranges that spread repeated keys with their CRCs."""
    n_parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"], n_parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("row_no").to_numpy(zero_copy_only=False), n, seed)
            more = [pa.array(p % shards, pa.int32()), pa.array(p // shards, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "shard", "slot"])

    return rows.select("doc_id", "size", "text_crc32", "row_no").mapInArrow(
        work, "doc_id long, size long, text_crc32 long, row_no long, shard int, slot long"
    )
