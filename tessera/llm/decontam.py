"""Benchmark decontamination (3): an FM-index per training shard.

Every task cuts its documents into shards of about `SHARD_WORDS` words and builds an FM-index of
each: the word sequence's suffix array, its Burrows-Wheeler transform in a wavelet matrix with
popcount ranks, and suffix positions sampled along the text. All test phrases (windows of 13
consecutive words; a shorter item is one window) are searched backwards at once, occurrences are
located by walking to a sampled position, and overlapping occurrences merge into removal spans.

Words that no phrase has, and stretches between them that are shorter than the shortest phrase,
cannot lie in an occurrence; in the shard's sequence they shrink to one separator each.

The phrases are broadcast in blocks of at most `BLOCK_BYTES` of benchmark text, measured before;
further blocks are further passes over the rows, without a shuffle. No row leaves its task.

Cases: null or wordless texts have no words and no hits; null or wordless items have no window;
equal items are searched once and all their ids are reported (a null id as the empty string);
repeated rows are judged each for itself; empty tables give no rows or no hits; other columns
pass through, clashing names included, inside the struct `row`; a very long text is a shard of its own;
no result depends on ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALNUM, alnum_words, small_batches

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_BYTES = 8 << 20
SAMPLE = 8
FOUND = "n_words long, spans array<struct<start:long,length:long>>, item_ids array<string>"
WORD = re.compile(rb"[^ ]+")


class Phrases:
    """Distinct windows of the items, as numbers of words, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        for item, words in items:
            w = tuple(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(w[i : i + window], set()).add(number[item])
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        width = int(self.lengths.max()) if found else 0
        #: Right-aligned, so that column -1 is every phrase's last word.
        self.words = np.zeros((len(found), width), np.int64)
        for k, p in enumerate(found):
            self.words[k, width - len(p) :] = p
        owners = [sorted(x) for x in found.values()]
        self.owner_starts = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([x for own in owners for x in own], np.int64)


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix over numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(levels - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in [0, i)."""
        start = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i, start = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rs, start - rs)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at i, and its occurrences in [0, i)."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for _, bits, zeros in self.levels:
            one, ri, rs = bits.get(i), bits.rank(i), bits.rank(start)
            c = c << 1 | one
            i, start = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rs, start - rs)
        return c, i - start


def suffix_array(text: np.ndarray, separators: int) -> np.ndarray:
    """By prefix doubling. Zeros are separators, each sorted by its place, so that no repeat runs
    across them; ranks of settled suffixes end the doubling early."""
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text + separators).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(text)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class Index:
    """FM-index of a sequence of runs of word numbers, each run followed by a separator 0."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, top: int):
        """offsets: each position's place in its run; runs' starts are always sampled."""
        n = len(text)
        sa = suffix_array(text, int((text == 0).sum()))
        self.n, self.bwt = n, Wavelet(text[sa - 1], max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        sampled = offsets[sa] % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), sa[sampled]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases together: their row ranges, empty if they don't occur."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        live = np.arange(len(words))
        for step in range(words.shape[1]):
            live = live[high[live] > low[live]]
            go = live[lengths[live] > step]
            if not len(go):
                break
            c = words[go, words.shape[1] - 1 - step]
            low[go], high[go] = self.first[c] + self.bwt.rank(c, low[go]), self.first[c] + self.bwt.rank(c, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text until a sampled row."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.sampled.get(rows[todo])
            done = todo[there]
            out[done] = self.positions[self.sampled.rank(rows[done])] + steps[done]
            todo = todo[~there]
            c, before = self.bwt.access_rank(rows[todo])
            rows[todo] = self.first[c] + before
            steps[todo] += 1
        return out


def search_shard(numbers: np.ndarray, docs: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """numbers: word numbers of a shard, 0 for words that no phrase has; docs: each word's document.

    Returns spans (first word, words) within the shard, merged, and pairs (document, item)."""
    none = np.empty((0, 2), np.int64)
    known = numbers > 0
    broken = np.concatenate([[True], (docs[1:] != docs[:-1])]) if len(docs) else known
    starts = np.flatnonzero(known & (broken | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & np.concatenate([broken[1:] | ~known[1:], [True]])) + 1
    long = ends - starts >= max(1, phrases.shortest)
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts) or not len(phrases.lengths):
        return none, none
    total = int(sizes.sum())
    run = np.repeat(np.arange(len(starts)), sizes)
    offset = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(total) + run  # one separator after each run
    text, where, offsets = (np.zeros(total + len(starts), np.int64) for _ in range(3))
    text[place], where[place], offsets[place] = numbers[starts[run] + offset], starts[run] + offset, offset
    offsets[place[np.cumsum(sizes) - 1] + 1] = SAMPLE - 1  # separators aren't sampled; none is reached
    index = Index(text, offsets, len(phrases.vocabulary))
    low, high = index.search(phrases.words, phrases.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    if not len(phrase):
        return none, none
    rows = np.repeat(low, counts) + np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = where[index.locate(rows)]
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(hit & (broken | ~np.concatenate([[False], hit[:-1]])))
    stop = np.flatnonzero(hit & np.concatenate([broken[1:] | ~hit[1:], [True]])) + 1
    pairs = np.unique(np.stack([docs[at], phrase], 1), axis=0)
    many = phrases.owner_starts[pairs[:, 1] + 1] - phrases.owner_starts[pairs[:, 1]]
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    items = np.stack([np.repeat(pairs[:, 0], many), phrases.owners[np.repeat(phrases.owner_starts[pairs[:, 1]], many) + inner]], 1)
    return np.stack([edge, stop - edge], 1), np.unique(items, axis=0)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return [{"start": a, "length": n} for a, n in out]


def _pass(rows: DataFrame, text: str, phrases: Phrases, shard_words: int) -> DataFrame:
    """One pass of one block of phrases; adds to the spans and items of earlier passes."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
        get = shared.value.vocabulary.get
        kept, words, total = [], [], 0
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([*batch.columns, batch.column("row").field(text)], [*batch.schema.names, "_text"])
            for part in small_batches(iter([flat]), "_text", 1 << 20):
                own = [np.array([get(w, 0) for w in alnum_words(t)], np.int64) for t in part.column("_text").to_pylist()]
                kept.append(part.drop_columns(["_text"]))
                words += own
                total += sum(map(len, own))
                if total >= shard_words:
                    yield kept, words
                    kept, words, total = [], [], 0
        if kept:
            yield kept, words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for kept, words in shards(batches):
            sizes = np.array(list(map(len, words)), np.int64)
            begins = np.cumsum(sizes) - sizes
            spans, items = search_shard(np.concatenate(words), np.repeat(np.arange(len(words)), sizes), phrases)
            by_doc: list[list[tuple[int, int]]] = [[] for _ in words]
            for a, n in spans.tolist():
                d = int(np.searchsorted(begins, a, side="right")) - 1
                by_doc[d].append((a - int(begins[d]), n))
            ids: list[set[str]] = [set() for _ in words]
            for d, k in items.tolist():
                ids[d].add(phrases.ids[k])
            at = 0
            for part in kept:
                n = part.num_rows
                old_spans, old_ids = part.column("spans").to_pylist(), part.column("item_ids").to_pylist()
                new_spans = [_merged([(x["start"], x["length"]) for x in o or []] + s) for o, s in zip(old_spans, by_doc[at : at + n], strict=True)]
                new_ids = [sorted(set(o or []) | s) for o, s in zip(old_ids, ids[at : at + n], strict=True)]
                span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(sizes[at : at + n], pa.int64()), pa.array(new_spans, span), pa.array(new_ids, pa.list_(pa.string()))],
                    ["row", "n_words", "spans", "item_ids"],
                )
                at += n

    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, {FOUND}")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """row (the document's columns), n_words, spans (merged, in words) and item_ids (sorted strings)."""
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:long,length:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("item_ids")
    )
    for b in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else bench
        rows = _pass(rows, text, Phrases([(r["item"], alnum_words(r["text"])) for r in part.collect()], window), shard_words)
    return rows


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data.translate(ALNUM))]
    out, at = [], 0
    for a, n in spans:
        out.append(data[at : words[a][0]])
        at = words[a + n - 1][1]
    return b"".join([*out, data[at:]]).decode()
