"""N-gram Jaccard join (12): universe-partition pigeonhole.

Two sets whose Jaccard similarity is at least `percent` / 100 differ in at most H elements, H following from
their sizes. Sizes are put in bands; in each band the hashed universe of shingles is cut into m segments, D of
which are matched with one deletion. If two sets of the band differ by one at least in every segment, and by two in
each of the D, they differ by m + D at least; so with m + D > H two similar sets have a segment that is equal, or, of
the D, one that differs by one shingle at most. A set therefore stands in one list for each segment's subset, and in
one more for each subset without one shingle in the D segments; similar sets meet in a list.

Allocation by cost: the lengths of the lists are counted over all documents first (in `BUCKETS`
buckets, those that stand out). Every set may leave out its `spare` costliest steps (a segment, or the deletions of one
of the D), and m + D is H + 1 + 2 `spare`, so that two sets which both leave out theirs still meet. That keeps sets off the
lists of empty segments and of subsets that many unlike documents have. Small bands get deletions instead of more
segments, so that a segment holds `MEAN` shingles at least on average.

Texts of equal words are one node. Each list's nodes are compared with one hub (the node that meets the most others), then those still in other components with
further hubs (`further_stars`), then all pairs that are still open, in blocks; lists of any length lose no component. Pairs whose sizes
or sketches (the parity of the numbers of shingles in 2 to 4 n bins, which differ in no more bins than the sets differ by) rule the
similarity out aren't compared; for all others the sets decide, as 64-bit hashes of shingles (two of
a pair of texts of 20 000 words collide once in 10^10 pairs).

Cases: texts without words (null, empty) have no shingles and are linked with nothing; fewer words than a
shingle are one shingle; copies and repeated rows are linked, a null id takes part and names a component only if
no other is there; ties of hubs go to the larger node; very long texts are rows like any other; empty tables give no rows; other columns aren't
read, clashing names included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix, small_batches, space_words
from tessera.operators.components import components, further_stars, open_pairs, unsettled
from tessera.sources.joins import bounded, spread_join
from tessera.sources.storage import materialize

SIZE, PERCENT = 4, 85
#: Pairs of one hub that are compared in one place.
MEETING = 64
#: Shingles that a segment holds at least on average; bytes of text that a task works on at a time.
MEAN, BATCH_BYTES = 4, 1 << 20
#: One step in so many, and one more, is spare: it costs a segment more and keeps a set off that many of its longest lists.
SPARE = 25
#: Bins of the parities that are held against each other where pairs are made; their columns.
FOLD = 256
FOLDS = [f"f{i}" for i in range(FOLD // 64)]
#: Buckets of the table of list lengths.
BUCKETS = 1 << 20


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` words; of the whole sequence if it is shorter."""
    words = space_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out = mix(out + h[j : n - size + 1 + j])
    return np.unique(out)


class Band(NamedTuple):
    """Sizes up to `high`; `segments` of which the first `deletions` are matched with one deletion; `spare` steps."""

    number: int
    segments: int
    deletions: int
    spare: int


@lru_cache(maxsize=1 << 12)
def band(number: int, percent: int) -> Band:
    low, high = band_start(number, percent), band_start(number + 1, percent) - 1
    most = 2 * high * (100 - percent) // (100 + percent)
    spare = 1 + (most + 1) // SPARE
    total = most + 1 + 2 * spare
    segments = max((total + 1) // 2, min(total, low // MEAN))
    return Band(number, segments, total - segments, spare)


@lru_cache(maxsize=1 << 12)
def band_start(number: int, percent: int) -> int:
    """The least size of a band: bands grow by the square of what similar sizes may differ by."""
    size = 1
    for _ in range(number):
        size = max(size + 1, int(np.ceil(size * (100 / percent) ** 2 - 1e-9)))
    return size


def bands(n: int, percent: int) -> list[int]:
    """The bands of a set of n: its own, and the next one if a set of that can be similar."""
    own = 0
    while band_start(own + 1, percent) <= n:
        own += 1
    return [own, own + 1] if 100 * n >= percent * band_start(own + 1, percent) else [own]


def fewest_lists(n: int, percent: int) -> int:
    """A set of n and a similar one that isn't larger meet in so many lists at least, less what they may differ by: their equal
    segments, of which the deletions of one count as another step. Sets in the lower part of a band may differ by less than its segments are made for."""
    if not n:
        return 0
    b = band(bands(n, percent)[0], percent)
    return max(0, b.segments - 2 * b.spare)


def segment_keys(h: np.ndarray, b: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the subsets of all segments; keys of the subsets without one shingle, and the segment of each. `h` is sorted, so
    segments, ranges of the hashed universe, are stretches of it; a subset's hash is the sum over its shingles."""
    at = ((h >> np.uint64(32)) * np.uint64(b.segments)) >> np.uint64(32)
    value = mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    bounds = np.searchsorted(at, np.arange(b.segments + 1).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    whole = sums[bounds[1:]] - sums[bounds[:-1]]
    place = mix(np.arange(b.segments).astype(np.uint64) + (np.uint64(b.number + 1) << np.uint64(32)))
    inside = at[: bounds[b.deletions]].astype(np.int64)
    return mix(whole + place), mix(whole[inside] - value[: len(inside)] + place[inside]), inside


def steps_left(whole: np.ndarray, without: np.ndarray, b: Band) -> np.ndarray:
    """Each segment's level after leaving out the costliest steps: 1 with deletions, 0 the subset only, -1 not at all."""
    level = (np.arange(b.segments) < b.deletions).astype(np.int64)
    for _ in range(b.spare):
        # Of a segment with deletions, the mean of both steps may be worth more than the first alone.
        first = np.maximum(without, (without + whole) / 2)
        saved = np.where(level == 1, first, np.where(level == 0, whole, 0))
        i = int(np.argmax(saved))
        if saved[i] <= 0:
            break
        level[i] -= 1
    return level


def lists_of(h: np.ndarray, percent: int, costs: np.ndarray) -> np.ndarray:
    """The keys of all lists that the set stands in."""
    out = []
    for number in bands(len(h), percent):
        b = band(number, percent)
        whole, without, inside = segment_keys(h, b)
        own = costs[(whole % np.uint64(BUCKETS)).astype(np.int64)]
        deleted = np.bincount(inside, costs[(without % np.uint64(BUCKETS)).astype(np.int64)], b.segments)
        level = steps_left(own, deleted, b)
        out += [whole[level >= 0], without[level[inside] == 1]]
    return np.unique(np.concatenate(out))


def sketch(h: np.ndarray) -> bytes:
    """Which of a power of two of bins, 2 n at least, hold an odd number of shingles."""
    bins = 1 << max(6, (2 * len(h) - 1).bit_length())
    at = mix(h + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bins - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bins) & 1, bitorder="little").tobytes()


def differences(x: bytes, y: bytes) -> int:
    """No more than the sets of both sketches differ by. The larger one is folded first."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def parities(h: np.ndarray) -> np.ndarray:
    """A sketch of `FOLD` bins for sets of every size, as whole numbers of 64 bits."""
    at = (mix(h + np.uint64(0xD1B54A32D192ED03)) & np.uint64(FOLD - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=FOLD) & 1, bitorder="little").view(np.int64)


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """False only for pairs whose sizes or parities rule the similarity out."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in FOLDS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def _read(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, top, sketch, parities) of each node's set, and, with a null n, (bucket as id, length of its lists)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "top", "sketch", "length", *FOLDS]
        counts = np.zeros(BUCKETS, np.int32)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            for h in sets:
                for number in bands(len(h), percent) if len(h) else ():
                    whole, without, _ = segment_keys(h, band(number, percent))
                    np.add.at(counts, (np.concatenate([whole, without]) % np.uint64(BUCKETS)).astype(np.int64), 1)
            folds = np.array(list(map(parities, sets)), np.int64).reshape(-1, len(FOLDS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, sets)), pa.int64()), pa.array([fewest_lists(len(h), percent) for h in sets], pa.int64()), pa.array(list(map(sketch, sets)), pa.binary()), pa.nulls(len(sets), pa.int64()), *map(pa.array, folds.T)], names)
        mean = counts.mean()
        found = np.flatnonzero(counts > max(1, mean + 3 * mean**0.5))
        for i in range(0, len(found), 1 << 14):
            part = found[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary()), pa.array(counts[part].astype(np.int64)), *[pa.nulls(len(part), pa.int64())] * len(FOLDS)], names)

    return texts.mapInArrow(work, "id long, n long, top long, sketch binary, length long, " + ", ".join(f"{f} long" for f in FOLDS))


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def jaccard_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document; the least id that is reachable by links."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("t"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            h = [xxhash.xxh128_digest(b" ".join(w)) if (w := space_words(t)) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(h, pa.binary())], ["doc_id", "t", "h"])

    prints = materialize(slim.mapInArrow(read, "doc_id long, t long, h binary"), "prints")
    some = prints.filter("h is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    nodes = materialize(some.groupBy("h").agg(first, F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("id"), "h", "first", "copies"), "nodes")

    def texts(wanted: DataFrame, *more: str) -> DataFrame:
        """(id, the columns `more`, text) of the nodes `wanted`; of rows equal in id and text all come."""
        keys = bounded(wanted.select("id", *more, F.col("first.doc_id").alias("i"), F.col("first.t").alias("u")))
        return slim.join(keys, slim["doc_id"].eqNullSafe(keys["i"]) & (slim["t"] == keys["u"])).select("id", *more, "text")

    seen = materialize(_read(texts(nodes), size, percent), "seen")
    buckets = seen.filter("n is null").groupBy("id").agg(F.sum("length").alias("n")).toArrow()
    costs = np.zeros(BUCKETS)
    costs[buckets.column("id").to_numpy()] = buckets.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    sizes = materialize(seen.filter("n is not null").select("id", "n", "top", "sketch", *FOLDS).dropDuplicates(["id"]), "sizes")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            keys, ids = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = lists_of(shingle_set(t, size), percent, shared.value)
                keys.append(own.view(np.int64))
                ids.append(np.full(len(own), i))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids)], ["key", "id"])

    index = materialize(texts(nodes).mapInArrow(entries, "key long, id long"), "index")
    lists = materialize(index.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("members")).filter("members > 1 and hub < last"), "lists")

    def may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b"))
            keep = [(100 + percent) * differences(*p) <= (100 - percent) * sum(q) for p, q in zip(zip(x, y, strict=True), zip(n, m, strict=True), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text")), strict=True):
                s = shingle_set(t, size)
                if b is None:
                    held, own = (a, part), s
                elif (a, part) == held:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of `pairs` that are similar; a tally `lists` of all lists that they meet in is held against the least that similar sets meet in. A hub's pairs are cut into parts of about `MEETING`; its text and those
        of a part's others meet in one stretch of a sorted shuffle, so that each text is moved once for each pair."""
        side = lambda c, *more: sizes.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in more])
        both = pairs.join(bounded(side("a", "n", "top")), "a").join(bounded(side("b", "n", "top")), "b")
        apart = F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent) + 1e-9)
        often = F.col("lists") >= F.when(F.col("n_a") >= F.col("n_b"), F.col("top_a")).otherwise(F.col("top_b")) - apart if "lists" in pairs.columns else F.lit(True)
        sized = materialize(both.filter(similar_sizes("n_a", "n_b", percent) & often).select("a", "b", "n_a", "n_b"), "sized")
        held = sizes.join(bounded(sized.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi").select("id", "sketch")
        of_held = lambda c: held.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
        likely = materialize(sized.join(of_held("a"), "a").join(of_held("b"), "b").mapInArrow(may_be_alike, "a long, b long"), "candidates")
        parts = materialize(likely.groupBy("a").agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("parts")), "parts")
        cut = spread_join(likely, parts, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
        others = cut.select(F.col("b").alias("id"), "a", "part", "b")
        hubs = cut.select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
        wanted = materialize(others.unionByName(hubs).join(bounded(nodes.select("id", "first")), "id").select("id", "a", "part", "b", "first"), "wanted")
        read = texts(wanted, "a", "part", "b").select("a", "part", "b", "text")
        meet = read.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        return materialize(meet.mapInArrow(alike, "a long, b long").distinct(), "links")

    # A list of two is its pair; of longer ones each node meets the hub.
    two = lists.filter("members = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))
    longer = materialize(lists.filter("members > 2").select("key", "members"), "longer")
    listed = materialize(spread_join(index, longer, ["key"], "members").select("key", "id", "members"), "listed")
    # The hub is the node that meets the most others over all its lists: of a group of near copies, what they are copies of.
    met = materialize(listed.groupBy("id").agg(F.sum("members").alias("meets"), F.count("*").alias("lists")), "met")
    ranked = materialize(spread_join(listed, met, ["id"], "lists").select("key", "id", "members", "meets"), "ranked")
    hubs = materialize(ranked.groupBy("key").agg(F.max(F.struct("meets", "id")).alias("hub"), F.first("members").alias("members")).select("key", F.col("hub.id").alias("hub"), "members"), "hubs")
    listed = materialize(spread_join(ranked.select("key", "id"), hubs, ["key"], "members").select("key", "id", "hub"), "listed")
    links = verified(two.unionByName(listed.filter("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))).distinct())
    split = unsettled(listed.drop("hub"), components(links), "id", ["key"])
    links, split = further_stars(links, split, "id", ["key"], verified)
    # A pair that meets in a list of two is compared already, so the tally of an open pair counts all its lists.
    with_parities = split.join(bounded(sizes.select("id", "n", *FOLDS)), "id")
    links = links.unionByName(verified(open_pairs(with_parities, "id", ["key"], lambda x, y: may_be_similar(x, y, percent))))
    found = components(links)
    named = materialize(nodes.join(found, nodes["id"] == found["node"], "left").join(sizes.select("id", "n"), "id").select("h", "copies", "n", F.col("first.doc_id").alias("least"), F.coalesce("component", nodes["id"]).alias("component")), "named")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    classes = materialize(spread_join(named, least, ["component"]).select("h", "copies", F.col("n").alias("n_shingles"), "component_id"), "classes")
    known = spread_join(some.select("doc_id", "h"), classes, ["h"], "copies").select("doc_id", "n_shingles", "component_id")
    return known.unionByName(prints.filter("h is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
