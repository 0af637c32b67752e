"""Packing (8): concatenate and cut.

Every document becomes its token ids and one end id. All documents are laid end to end in the
order of the written token table, and the line of tokens is cut into windows of `width`.
Offsets come from two passes: a pass that tokenizes and writes each partition's running sums,
and a prefix sum over the partitions' totals, one number per partition. Each row then knows its
global offset, so windows are cut independently on every row; no row meets another.

Cases: null and empty texts are the end id alone; repeated rows and ids are packed each for
itself; an empty table gives no pieces; columns other than the two named are not read, clashing names
included; a text longer than a window, however long, is cut into several pieces, `n_pieces` and
`continues` being its boundary records; there are no ties, as the order is that of the written rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import small_batches
from tessera.sources.storage import materialize

WIDTH = 2048
END_ID = 1
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "n_pieces long, continues boolean"
)


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The special tokens of a tokenizers file: their strings in a text become these ids."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """text -> ids. A `.tiktoken` file is a list of byte strings and ranks, to which the `special` tokens
    are added; else a tokenizers file, which has its own. Both read special tokens' strings in a text
    as those tokens."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        return lambda text: own.encode(text, allowed_special="all") if any(x in text for x, _ in special) else own.encode_ordinary(text)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def tokenize(docs: DataFrame, path: str, pattern: str, special: tuple = (), end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, part, local, n, ids): the ids of each document with the end id, as little-endian unsigned
    16- or 32-bit numbers (`wide`); `local` is the number of ids before it in its partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, local = encoder(path, pattern, special), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text", 4 << 20):
            keys, n, at, ids, wide = batch.column("doc_id"), [], [], [], []
            for value in batch.column("text").to_pylist():
                got = encode(value) if value else []
                got.append(end_id)
                a = np.array(got, "<u4")
                large = bool(a.max() > 65535)
                ids.append((a if large else a.astype("<u2")).tobytes())
                wide.append(large)
                at.append(local)
                n.append(len(got))
                local += len(got)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "local", "n", "wide", "ids"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, part int, local long, n long, wide boolean, ids binary"
    )


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Second pass: each row's global offset `at`. The prefix sum runs over one total per partition;
    a partition of the input holds a file split, so a million totals stand for over a hundred TB."""
    totals = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([0, *(r["n"] for r in totals)]).tolist()
    bases = tokens.sparkSession.createDataFrame(
        [(r["part"], e) for r, e in zip(totals, ends, strict=False)], "part int, base long"
    )
    return tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("local"))


def cut(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Cut each document at the multiples of `width` on the line of all tokens: one row per piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, n, wide, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "wide", "ids")), strict=True):
                data = ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                first, last = at // width, (at + n - 1) // width
                for seq in range(first, last + 1):
                    a, b = max(seq * width, at) - at, min((seq + 1) * width, at + n) - at
                    rows.append((doc, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b]), n, seq, (at + a) % width, last - first + 1, seq < last))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_pieces", "continues"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return placed.select("doc_id", "at", "n", "wide", "ids").mapInArrow(work, PIECES)


def pack(docs: DataFrame, path: str, pattern: str, special: tuple = (), width: int = WIDTH, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: document, place in it, CRC of its ids, sequence and offset there.

    All sequences but the last are full. The token table is written once to shared storage, so a
    retried task reads the same order.
    """
    tokens = materialize(tokenize(docs, path, pattern, special, end_id, text, key), "tokens")
    return cut(with_offsets(tokens), width)
