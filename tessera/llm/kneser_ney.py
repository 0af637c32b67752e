"""LM scoring (2): an interpolated modified Kneser-Ney n-gram model over words.

Counting runs in Spark. Words are 64-bit hashes; an n-gram is a row of `order` of them. Tasks
count n-grams of their own rows in memory-bounded chunks and send them on as sorted numpy blocks,
split by ranges of the n-gram's own hash (each block with its own list of words), so that one frequent word, pair or context is spread
over all ranges. Each range adds its blocks up, writes one sorted array of hashes with counts to
the shared folder, and passes on two pre-aggregated kinds of blocks: sums by context (total and
how many n-grams occur once, twice, more often) and by suffix (the continuation counts that are
the next lower order). This repeats down to single words. Discounts come from the counts of counts.

Scoring maps these arrays into memory (`numpy.memmap`); workers of one machine share the pages,
and only pages that are looked up are read. p(w|h) = (c(hw) - D) / c(h) + g(h) p(w|h'), down to
single words and then 1 / (V + 1) for each word, known or not; so probabilities sum to one.

The shared folder must be a mounted path (`file:` or none); files are renamed into place whole, so
a retried task only writes the same file again.

Cases: null and empty texts are the end token alone; a text shorter than the order has shorter
contexts (the start is padded); repeated rows count each; with nothing to learn from, V = 0 and
every token has probability 1 / (V + 1) = 1; an empty table gives no rows; a very long text is counted
and scored whole; no result depends on ties; other columns pass in the struct `row`, clashing names included.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import small_batches
from tessera.sources.storage import new_dir

ORDER = 2
START, END = np.uint64(1), np.uint64(2)
CHUNK_BYTES = 3 << 20
#: Tokens that a task counts at a time; each text is counted whole, however long.
CHUNK_TOKENS = 1_500_000
#: Text for each range of hashes.
BUCKET_BYTES = 8 << 20
BLOCK = "kind string, level int, bucket int, block binary"
SCORE = "n_tokens long, n_known long, base_score double, score double"
U = np.uint64


def _hash(words: list[bytes | str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words)) | U(4)  # 1 and 2 are the marks


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in a row, and each text's number of tokens. Words are split
    at the ASCII white space and A-Z is lower-cased; each text ends with the end token."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = _hash(words) if words else np.zeros(0, np.uint64)
    filled = np.array([w != "" for w in words], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    docs = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(words) and not filled.all():
        keep = filled[codes]
        codes, docs = codes[keep], docs[keep]
    sizes = np.bincount(docs, minlength=len(texts)) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    return out, sizes


def ngrams(ids: np.ndarray, sizes: np.ndarray, order: int, start=START) -> list[np.ndarray]:
    """`order` columns: every token after the tokens before it in its text; the start is padded."""
    place = np.arange(len(ids), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns = [ids]
    for k in range(1, order):
        before = np.full(len(ids), start, ids.dtype)
        before[k:] = ids[:-k]
        before[place < k] = start
        columns.append(before)
    return columns[::-1]


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of word hashes, given in columns."""
    h = np.full(len(columns[0]), 0x51ED270B, np.uint64)
    with np.errstate(over="ignore"):
        for x in columns:
            h = (h ^ x) * U(0x9E3779B97F4A7C15)
            h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
            h ^= h >> U(29)
    return h


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that the buckets' arrays lie one after another in sorted order."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _distinct(codes: list[np.ndarray], size: int, counts: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal rows of `codes` (numbers below `size`, in columns) added up; without `counts` each row is one."""
    bits = max(1, (size - 1).bit_length())
    if bits * len(codes) > 64:
        # A vocabulary beyond the key: number the rows' beginnings first.
        head, back = np.unique(np.stack(codes[:-1]), axis=1, return_inverse=True)
        two, sums = _distinct([back.ravel().astype(np.uint64), codes[-1].astype(np.uint64)], max(head.shape[1], size), counts)
        return [*(x[two[0].astype(np.int64)] for x in head), two[1]], sums
    key = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        key = (key << U(bits)) | c.astype(np.uint64)
    if counts is None:
        key, n = np.unique(key, return_counts=True)
        sums = [n]
    elif len(key):
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, sums = key[first], [np.add.reduceat(c[order], first, dtype=np.int64) for c in counts]
    else:
        sums = [c.astype(np.int64) for c in counts]
    mask = U((1 << bits) - 1)
    return [(key >> U(bits * k)) & mask for k in range(len(codes) - 1, -1, -1)], sums


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if a.size else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def _unpack(block: bytes, n: int) -> list[np.ndarray]:
    f = io.BytesIO(block)
    return [np.lib.format.read_array(f, allow_pickle=False) for _ in range(n)]


def _blocks(kind: str, level: int, words: np.ndarray, codes: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """One block for each range of the hash: its distinct words, the rows (sorted) as numbers of them in
    columns, the first as differences, and the counts, all in the narrowest type."""
    codes = [c.astype(np.int64) for c in codes]
    b = _bucket(fold([words[c] for c in codes]), buckets)
    order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")
    edges = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        rows = order[edges[k] : edges[k + 1]]
        if len(rows):
            own, back = np.unique(np.concatenate([c[rows] for c in codes]), return_inverse=True)
            first, *rest = back.reshape(len(codes), -1)
            yield kind, level, k, _pack(words[own], _narrow(np.diff(first, prepend=0)), *map(_narrow, rest), *(_narrow(c[rows]) for c in counts))


def _read(kind: str, level: int, block: bytes) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(distinct words, rows as numbers of them, counts) of a block."""
    width = level - 1 if kind == "context" else level
    words, *rest = _unpack(block, 1 + width + (4 if kind == "context" else 1))
    rest[0] = np.cumsum(rest[0], dtype=np.int64)
    return words, rest[:width], rest[width:]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "level", "bucket", "block"])


def count(docs: DataFrame, order: int, buckets: int, text: str = "text") -> DataFrame:
    """Blocks of n-gram counts ('gram') and of single token counts ('raw')."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words, codes = np.unique(np.append(ids, START), return_inverse=True)
            codes, start = codes[:-1].astype(np.uint32), np.uint32(codes[-1])
            for kind, level in (("gram", order), ("raw", 1)):
                for row in _blocks(kind, level, words, *_distinct(ngrams(codes, sizes, level, start), len(words)), buckets):
                    yield _rows([row])

        for batch in small_batches(batches, "text", CHUNK_BYTES):
            held.append(tokens(batch.column("text")))
            if sum(len(x[0]) for x in held) > CHUNK_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(work, BLOCK)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write whole, then rename."""
    path = f"{folder}/{name}.npy"
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array, allow_pickle=False)
    os.replace(part, path)


def reduce(blocks: DataFrame, folder: str, buckets: int, partitions: int) -> DataFrame:
    """One level: adds blocks up, writes arrays, passes on context and suffix blocks and summaries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for kind, level, bucket, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "summary":
                    yield _rows([(kind, level, bucket, block)])
                else:
                    held.setdefault((kind, level, bucket), []).append(block)
        for kind, level, bucket in sorted(held):
            parts = [_read(kind, level, b) for b in held.pop((kind, level, bucket))]
            words = np.unique(np.concatenate([p[0] for p in parts]))
            numbers = [np.searchsorted(words, p[0]).astype(np.uint32) for p in parts]
            codes = [np.concatenate([m[p[1][k]] for m, p in zip(numbers, parts, strict=True)]) for k in range(len(parts[0][1]))]
            counts = [np.concatenate([p[2][k] for p in parts]) for k in range(len(parts[0][2]))]
            del parts, numbers
            codes, counts = _distinct(codes, len(words), counts)
            h = fold([words[c.astype(np.int64)] for c in codes])
            order = np.argsort(h)
            name = f"{kind}{level}-{bucket}"
            _save(folder, f"{name}-h", h[order])
            for k, c in enumerate(counts):
                _save(folder, f"{name}-{k}", _narrow(c[order]))
            del h, order
            c = counts[0]
            if kind == "raw":
                yield _rows([("summary", 0, bucket, _pack(np.array([len(c), c.sum()])))])
            if kind == "gram":
                kinds = np.array([(c == 1).sum(), (c == 2).sum(), (c == 3).sum(), (c == 4).sum(), (c > 2).sum(), c.sum()])
                yield _rows([("summary", level, bucket, _pack(kinds))])
                if level > 1:
                    for row in _blocks("context", level, words, *_distinct(codes[:-1], len(words), [c, c == 1, c == 2, c > 2]), buckets):
                        yield _rows([row])
                    for row in _blocks("gram", level - 1, words, *_distinct(codes[1:], len(words)), buckets):
                        yield _rows([row])

    return blocks.repartition(partitions, "kind", "level", "bucket").mapInArrow(work, BLOCK)


class Model:
    """Memory-mapped arrays of all levels, with discounts."""

    def __init__(self, folder: str, order: int, buckets: int, sums: dict[int, np.ndarray]):
        self.folder, self.order, self.buckets, self.sums = folder, order, buckets, sums
        self.types, self.total = (int(x) for x in sums.get(0, np.zeros(2)))
        self.discounts = {}
        for k in range(1, order + 1):
            n1, n2, n3, n4 = (float(x) for x in sums.get(k, np.zeros(6))[:4])
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            self.discounts[k] = np.array([0.0] + [min(max(x, 0.05), j + 0.95) for j, x in enumerate(d)])

    def look_up(self, kind: str, level: int, h: np.ndarray, columns: int) -> np.ndarray:
        """Counts at the hashes h (sorted), zero where missing."""
        out = np.zeros((columns, len(h)), np.int64)
        edges = np.searchsorted(_bucket(h, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            keys, *values = _mapped(self.folder, f"{kind}{level}-{b}", columns)
            if len(keys):
                i, j = edges[b], edges[b + 1]
                at = np.minimum(np.searchsorted(keys, h[i:j]), len(keys) - 1)
                there = keys[at] == h[i:j]
                for k, v in enumerate(values):
                    out[k, i:j] = np.where(there, v[at], 0)
        return out

    def log_probs(self, grams: list[np.ndarray]) -> np.ndarray:
        """log10 p(last word | words before) of each row of word hashes, in columns."""
        n = len(grams[0])
        p = np.full(n, 1.0 / (self.types + 1))
        for k in range(1, self.order + 1):
            d = self.discounts[k]
            words = grams[self.order - k :]
            h, back = np.unique(fold(words), return_inverse=True)
            c = self.look_up("gram", k, h, 1)[0][back]
            if k == 1:
                s = self.sums.get(1, np.zeros(6))
                total, n1, n2, n3 = (np.full(n, int(x)) for x in (s[5], s[0], s[1], s[4]))
            else:
                h, back = np.unique(fold(words[:-1]), return_inverse=True)
                total, n1, n2, n3 = self.look_up("context", k, h, 4)[:, back]
            seen = total > 0
            t = np.maximum(total, 1)
            share = (c - d[np.minimum(c, 3)]) / t
            weight = np.where(seen, (d[1] * n1 + d[2] * n2 + d[3] * n3) / t, 1.0)
            p = np.where(seen, share, 0.0) + weight * p
        return np.log10(p)

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        ids, sizes = tokens(texts)
        starts = np.cumsum(sizes) - sizes
        grams = ngrams(ids, sizes, self.order)
        h, first, back = np.unique(fold(grams), return_index=True, return_inverse=True)
        logs = self.log_probs([x[first] for x in grams])[back]
        h, first, back = np.unique(fold([ids]), return_index=True, return_inverse=True)
        c = self.look_up("raw", 1, h, 1)[0]
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))
        add = lambda x: np.add.reduceat(x, starts)
        return [sizes, add((c > 0)[back].astype(np.int64)), add(base[back]), add(logs)]


@lru_cache(maxsize=1024)
def _mapped(folder: str, name: str, columns: int) -> list[np.ndarray]:
    if not os.path.exists(f"{folder}/{name}-h.npy"):
        return [np.zeros(0, np.uint64)] + [np.zeros(0, np.uint8)] * columns
    return [np.load(f"{folder}/{name}-{x}.npy", mmap_mode="r") for x in ("h", *range(columns))]


def train(docs: DataFrame, order: int = ORDER, text: str = "text", buckets: int | None = None, folder: str | None = None) -> Model:
    """Count all of `docs` and write the model's arrays."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
    partitions = max(partitions, buckets)
    uri = folder or new_dir(spark, "lm")
    path = uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri
    if "://" in path:
        raise ValueError(f"memory-mapped arrays need a mounted folder, not {uri}")
    os.makedirs(path, exist_ok=True)
    blocks = count(docs, order, buckets, text)
    for _ in range(order):
        blocks = reduce(blocks, path, buckets, partitions)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for level, block in zip(batch.column("level").to_pylist(), batch.column("block").to_pylist(), strict=True):
                own[level] = own.get(level, 0) + _unpack(block, 1)[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([v.tolist() for v in own.values()], pa.list_(pa.int64()))], ["level", "v"])

    found = blocks.filter("kind = 'summary'").select("level", "block").mapInArrow(add, "level int, v array<long>")
    columns = [F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(6)]
    sums = {r["level"]: np.array([r[f"v{k}"] for k in range(2 if r["level"] == 0 else 6)]) for r in found.groupBy("level").agg(*columns).collect()}
    return Model(path, order, buckets, sums)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row (the document's columns), n_tokens, n_known, base_score, score (log10)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text)], ["row", "text"])
            for part in small_batches(iter([flat]), "text", CHUNK_BYTES):
                columns = map(pa.array, model.score(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", *(x.split()[0] for x in SCORE.split(", "))])

    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, {SCORE}")
