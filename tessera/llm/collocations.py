"""Phrase collocation mining (11): an FM-index per shard over word ids.

Every task cuts its documents into shards of about `SHARD_WORDS` words of one language. A shard's pieces are a
sequence of word ids with separators; its bidirectional index is the Burrows-Wheeler transforms of the
sequence and of its reverse in wavelet matrices, sorted as deep as the longest phrase. A phrase is one interval in
each of them. Extending all intervals of a depth by every word to the left (or right) at once, down the wavelet
levels, enumerates the phrases one word longer with their counts and both intervals.

Counts are summed across shards twice. The first pass sums words and pairs by a 64-bit hash, a chunk of hashes at a time; the hashes
that reach the least count make a bitmap of fixed size (`HOT_BITS`), which goes to all tasks. In the second pass, words and pairs that the
bitmap doesn't hold can't be in any candidate, so the shards shrink to the stretches of the others; pairs are made by
extending words to the left, longer phrases by extending pairs to the right, and all are summed by their text. Collisions
only let more phrases pass to this exact count. Shards needn't be alike in both passes.

Scores are whole numbers from decimals of 38 digits. The first rows of each language come from parts of bounded size.

Cases: null texts have no words, a null language is `und`; empty tables give no rows; repeated rows count each; ties go by the
order asked for; a very long text is a shard of its own; columns other than the two named aren't read, clashing names included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.decontam import Wavelet
from tessera.llm.words import mix, small_batches
from tessera.sources.joins import spread_join
from tessera.sources.storage import materialize

#: Contract values: longest phrase, least count, rows of a language, percent of a phrase's count that a longer one must reach to drop it.
WORDS, LEAST, TOP, CONTAINED = 3, 10, 2000, 50
SHARD_WORDS, BATCH_BYTES = 1 << 21, 1 << 20
#: Bits of the bitmap of hashes; parts of a language's candidates that are ranked apart first.
HOT_BITS, PARTS = 27, 64
#: A chunk of the bitmap is 2 ** CHUNK bits; of a corpus' hashes a 4096th falls into each.
CHUNK = 15
#: Lower-cases A-Z; bytes that end a piece become 0xFF, which no UTF-8 text has.
PIECES = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """Words to numbers from 1 in order of appearance; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Texts of one language as numbers: `words` of the numbers, `text` with a 0 before, between and after pieces."""

    def __init__(self, texts: list[str]):
        numbers, parts = Numbers(), []
        for t in texts:
            found = t.encode().translate(PIECES).replace(b"\xff", b" \xff ").split()
            parts += [np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)), np.zeros(1, np.int64)]
        self.words = list(numbers)
        self.text = np.concatenate([np.zeros(1, np.int64), *parts])
        self.counts = np.bincount(self.text, minlength=len(self.words))


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A hash of each word in its language; that of number 0 isn't used."""
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(3) + mix(second))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the cyclic text, sorted by the `depth` numbers from there on."""
    base = int(text.max()) + 1
    key = text
    for d in range(1, depth):
        if (int(key.max()) + 1) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + np.roll(text, -d)
    return np.argsort(key)


class Side:
    """The transform of a text in a wavelet matrix, good for patterns of up to `depth` numbers."""

    def __init__(self, text: np.ndarray, depth: int):
        top = int(text.max())
        self.bwt = Wavelet(text[suffix_order(text, depth) - 1], max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])

    def extend(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All numbers before the rows of each interval: (interval, number, new low, new high), sorted by the first two."""
        source, number, start = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for _, bits, zeros in self.bwt.levels:
            ones_low, ones_high, ones_start = bits.rank(low), bits.rank(high), bits.rank(start)
            zero, one = high - ones_high > low - ones_low, ones_high > ones_low
            both = lambda x, y: np.concatenate([x[zero], y[one]])
            source, number = both(source, source), both(number << 1, number << 1 | 1)
            low, high, start = both(low - ones_low, zeros + ones_low), both(high - ones_high, zeros + ones_high), both(start - ones_start, zeros + ones_start)
        order = np.lexsort((number, source))
        source, number, before, count = source[order], number[order], (low - start)[order], (high - low)[order]
        return source, number, self.first[number] + before, self.first[number] + before + count


class BiIndex:
    """Both directions of a text, kept in step: `rows` (n, 4) are a pattern's intervals (low, high) in each."""

    def __init__(self, text: np.ndarray, depth: int):
        self.sides = Side(text, depth), Side(text[::-1], depth)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers from 1 that occur, and their rows."""
        first = self.sides[0].first
        found = np.flatnonzero(np.diff(first))
        found = found[found > 0]
        return found, np.stack([first[found], first[found + 1]] * 2, 1)

    def extend(self, rows: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, number, rows) of all extensions by a word to the left, or right; separators end them."""
        own, other = (slice(0, 2), slice(2, 4)) if left else (slice(2, 4), slice(0, 2))
        source, number, low, high = self.sides[0 if left else 1].extend(*rows[:, own].T)
        count = high - low
        # In the other direction an extension's rows follow those of its pattern's lesser ones.
        smaller = np.cumsum(count) - count
        begins = np.searchsorted(source, np.arange(len(rows)))
        there = rows[source, other.start] + smaller - (smaller[begins[source]] if len(source) else 0)
        out = np.empty((len(source), 4), np.int64)
        out[:, own], out[:, other] = np.stack([low, high], 1), np.stack([there, there + count], 1)
        word = number > 0
        return source[word], number[word], out[word]


def ngrams(text: np.ndarray, depth: int, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers (n, k), counts) of all phrases of k = 2 to `depth` words; `keep` (numbers of two words, next to each other) tells
    which pairs go on."""
    if not text.any():
        return
    index = BiIndex(text, depth)
    word, rows = index.words()
    source, number, rows = index.extend(rows, left=True)
    grams = np.stack([number, word[source]], 1)
    for k in range(2, depth + 1):
        if keep is not None:
            good = keep(grams[:, -2], grams[:, -1])
            grams, rows = grams[good], rows[good]
        yield grams, rows[:, 1] - rows[:, 0]
        if k < depth:
            source, number, rows = index.extend(rows, left=False)
            grams = np.concatenate([grams[source], number[:, None]], 1)


def shards(batches: Iterator[pa.RecordBatch], words: int = SHARD_WORDS) -> Iterator[tuple[str, Shard]]:
    """(language, shard) of about `words` words together, by the bytes of their texts."""
    held: dict[str, list[str]] = {}
    size = 0
    for batch in small_batches(batches, "text", BATCH_BYTES):
        for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(t)
            size += len(t)
        if size >= 6 * words:
            yield from ((x, Shard(texts)) for x, texts in held.items())
            held, size = {}, 0
    yield from ((x, Shard(texts)) for x, texts in held.items())


def _parted(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(chunk, h, n): hashes and their counts as bytes, by the chunk of the bitmap that the hashes fall into."""
    chunk = (h >> np.uint64(64 - HOT_BITS + CHUNK)).astype(np.uint16)
    order = np.argsort(chunk, kind="stable")
    sizes = np.bincount(chunk, minlength=1 << HOT_BITS - CHUNK)
    found = np.flatnonzero(sizes)
    ends = np.append(0, np.cumsum(sizes[found]))
    blobs = lambda x: pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), blobs(h[order]), blobs(n[order].astype(np.int32))], ["chunk", "h", "n"])


def hot_bits(rows: DataFrame, least: int, shard_words: int) -> np.ndarray:
    """`HOT_BITS` as bytes: bit h >> (64 - HOT_BITS) is set for the hashes h of words and pairs whose counts reach `least` (and of
    those that collide with such). A shard's hashes go out as one row for each chunk of the bitmap; the chunks are summed apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches, shard_words):
            own = hashes(lang, shard.words)
            side = Side(shard.text, 2)
            word = np.flatnonzero(shard.counts)
            word = word[word > 0]
            source, number, low, high = side.extend(side.first[word], side.first[word + 1])
            pair = number > 0
            h = np.concatenate([own[word], pair_hash(own[number[pair]], own[word[source[pair]]])])
            yield _parted(h, np.concatenate([shard.counts[word], (high - low)[pair]]))

    def part(key, table):
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int32)
        order = np.argsort(h)
        h = h[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        hot = h[starts][np.add.reduceat(n[order], starts, dtype=np.int64) >= least]
        bits = np.zeros(1 << CHUNK, bool)
        bits[(hot >> np.uint64(64 - HOT_BITS)).astype(np.int64) & ((1 << CHUNK) - 1)] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    chunks = materialize(rows.mapInArrow(work, "chunk int, h binary, n binary").groupBy("chunk").applyInArrow(part, "chunk int, bits binary"), "hot").toArrow()
    out = np.zeros((1 << HOT_BITS - CHUNK, 1 << CHUNK - 3), np.uint8)
    for c, b in zip(chunks.column("chunk").to_pylist(), chunks.column("bits").to_pylist(), strict=True):
        out[c] = np.frombuffer(b, np.uint8)
    return out.ravel()


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - HOT_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def hot_stretches(text: np.ndarray, own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The stretches of a text in which every two neighbouring words are a hot pair, with a 0 around each."""
    word = (text > 0) & holds(bits, own[text])
    pair = word[:-1] & word[1:]
    at = np.flatnonzero(pair)
    pair[at] = holds(bits, pair_hash(own[text[at]], own[text[at + 1]]))
    # A stretch's word stands in a hot pair; it ends where the pair with the next word isn't hot.
    begins, goes_on = np.append(False, pair), np.append(pair, False)
    kept = np.flatnonzero(begins | goes_on)
    ends = ~goes_on[kept]
    place = np.arange(len(kept)) + np.cumsum(ends) - ends + 1
    out = np.zeros(len(kept) + int(ends.sum()) + 1, np.int64)
    out[place] = text[kept]
    return out


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, phrase, n): all phrases of 2 to `words` words with `least` occurrences, the words in them, and under
    `words` 0 how many words a language has."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(hot_bits(rows, least, shard_words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for name, shard in shards(batches, shard_words):
            own = hashes(name, shard.words)

            def made(k: int, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
                size = len(phrases)
                texts = pa.array(phrases, pa.binary()).cast(pa.string())
                return pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array(np.full(size, k, np.int32)), texts, pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])  # noqa: B023

            total = int(shard.counts[1:].sum())
            if total:
                yield made(0, [b""], np.array([total]))
            word = np.flatnonzero(holds(bits, own) & (shard.counts > 0))
            word = word[word > 0]
            yield made(1, [shard.words[i] for i in word.tolist()], shard.counts[word])
            keep = lambda x, y: holds(bits, pair_hash(own[x], own[y]))  # noqa: B023, E731
            for grams, n in ngrams(hot_stretches(shard.text, own, bits), words, keep):
                for i in range(0, len(grams), 1 << 16):
                    part = grams[i : i + (1 << 16)]
                    columns = [list(map(shard.words.__getitem__, c.tolist())) for c in part.T]
                    yield made(part.shape[1], list(map(b" ".join, zip(*columns, strict=True))), n[i : i + (1 << 16)])

    found = rows.mapInArrow(work, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return found.filter((F.col("n") >= least) | (F.col("words") == 0))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    whole = lambda c: c.cast("decimal(19,0)")
    over = (whole(a) * whole(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, whole(left) * whole(right))


def scored(counts: DataFrame, words: int = WORDS) -> DataFrame:
    """Candidates (phrases of two words or more) with the parts of their lowest-scoring cut."""
    known = counts.filter("words > 0")
    cuts = counts.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    split = F.split("phrase", " ", -1)
    cuts = materialize(cuts.withColumns({"first": F.array_join(F.slice(split, 1, F.col("cut")), " "), "rest": F.array_join(F.slice(split, F.col("cut") + 1, F.col("words") - F.col("cut")), " ")}), "cuts")
    part = lambda c, n: known.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    both = spread_join(materialize(spread_join(cuts, part("first", "l"), ["lang", "first"]), "firsts"), part("rest", "r"), ["lang", "rest"])
    each = both.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    return each.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "m.l", "m.r", "m.score")


def extensions(counts: DataFrame) -> DataFrame:
    """(lang, phrase, left, right): how often a phrase's most frequent extension by one word to either side occurs."""
    longer = counts.filter("words > 2").withColumn("w", F.split("phrase", " ", -1))
    size = F.size("w")
    both = F.array(F.struct(F.array_join(F.slice("w", 2, size - 1), " ").alias("phrase"), F.col("n").alias("left"), F.lit(0).cast("long").alias("right")), F.struct(F.array_join(F.slice("w", 1, size - 1), " ").alias("phrase"), F.lit(0).cast("long").alias("left"), F.col("n").alias("right")))
    each = longer.select("lang", F.explode(both).alias("x")).select("lang", "x.phrase", "x.left", "x.right")
    return each.groupBy("lang", "phrase").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, left, right): the first `top` of each language.

    A phrase goes if a longer one that holds it has `contained` percent of its count; of those, one that is a word
    longer has the most."""
    counts = materialize(phrase_counts(docs, words, least, text, lang, shard_words), "phrases")
    around = materialize(extensions(counts), "extensions")
    own = materialize(scored(counts, words), "scored")
    known = own.join(around, ["lang", "phrase"], "left").fillna(0, ["left", "right"])
    free = known.filter(100 * F.greatest("left", "right") < contained * F.col("a"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = free.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "left", "right")
