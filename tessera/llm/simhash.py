"""SimHash near-dedup (1): a byte-position inverted index with count filtering.

A fingerprint is a row of bytes. Two fingerprints that differ in at most r bits differ in at most
r bytes, so they share at least `bytes` - r positional bytes: the count filter's minimum. One
positional byte alone has only 256 values and its posting lists would grow with the square of the
corpus. The positions are therefore cut into r + 2 blocks, of which such a pair shares two at least,
and a posting list stands under two blocks and one further positional byte. Pairs that meet are
tallied by a count of the lists, which is the number of shared bytes beyond the two blocks; pairs
with fewer than the minimum go, and the rest are verified.

Equal fingerprints are one node, so copies make no pairs. No list is expanded into all of its
pairs: each list's nodes are compared with one hub first, components are contracted, and only pairs
of a list that are still in different components are tallied (`near_fingerprints`) or compared
(`near_texts`); the members of a list's largest component aren't paired among themselves. That
holds for lists of every length, and loses no link: a pair that is never compared is connected
already.

`near_texts` takes its first pairs from that index too: texts whose fingerprints are equal or linked are compared by
their sets and contracted. A similarity of sets guarantees no shared bytes of fingerprints, so what the index can't
find is found exactly by a prefix filter over the shingles, which compares only texts that are still apart. Of those pairs most
aren't similar; sketches of a bit for each shingle, which never rule out a similar pair, tell that before sets are moved.

Cases: a text without words has fingerprint zero and is linked like any other; null is empty;
rows with equal ids are each fingerprinted; a null id takes part and is never chosen as the
component's name unless no other is there; very long texts are hashed `ROWS` shingles at a time;
ties of hubs go to the larger fingerprint (texts: the least row), which changes no component; other
columns aren't read (`near_texts` passes them on, clashing names included); empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import small_batches, space_words
from tessera.operators.components import components, unsettled
from tessera.sources.joins import bounded, spread_join
from tessera.sources.storage import materialize, scratch

SHINGLE, BITS = 3, 2
#: Bytes of text and rows of hashes that a task works on at a time.
BATCH_BYTES, ROWS = 1 << 20, 1 << 14
_ONES = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `size` words, space-joined, repeats included; the whole if fewer."""
    n, h = len(words), xxhash.xxh64_intdigest
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= size:
        return np.array([h(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :]
    return np.array([h(joined[i:j], seed) for i, j in zip(starts[: n - size + 1].tolist(), ends.tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bytes of the fingerprint(s): a bit is 1 if set in over half the rows of (n, bytes)."""
    n, width = hashes.shape
    tally = np.zeros(256 * width, np.int64)
    for i in range(0, n, ROWS):
        tally += np.bincount((hashes[i : i + ROWS] + 256 * np.arange(width)).ravel(), minlength=256 * width)
    counts = tally.reshape(width, 256) @ _ONES
    return np.packbits(2 * counts > n, axis=1, bitorder="little").ravel()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles; zero without words."""
    h = shingle_hashes(space_words(text), size)
    return int(majority(h.view(np.uint8).reshape(-1, 8)).view(np.uint64)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            fps = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def shared_bytes(x: Column, width: int = 8) -> Column:
    """How many positional bytes are zero in a difference of fingerprints."""
    same = [(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(width)]
    return sum(same[1:], same[0])


def _blocks(bits: int) -> list[list[int]]:
    """Positions of each index key: of `bits` + 2 blocks of the 8 bytes, any two together."""
    blocks = np.array_split(np.arange(8), bits + 2)
    return [sorted(int(i) for i in (*x, *y)) for x, y in itertools.combinations(blocks, 2)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")


def _by_key(bits: int, of) -> Column:
    """`of` (positions -> column) of the row's key `c`."""
    keys = _blocks(bits)
    out = of(keys[0])
    for c, own in enumerate(keys[1:], 1):
        out = F.when(F.col("c") == c, of(own)).otherwise(out)
    return out


def postings(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, copies, c, v, p, b): fingerprint `fp` stands in the list of key `c` with the bytes `v` and the
    further position `p` with the byte `b`. Nodes alone under their key are left out."""
    whole = [F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(_signed(sum(255 << 8 * i for i in own))).alias("v")) for c, own in enumerate(_blocks(bits))]
    first = nodes.select("fp", "copies", F.explode(F.array(*whole)).alias("k")).select("fp", "copies", "k.c", "k.v")
    met = first.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1").select("c", "v")
    byte = lambda i: F.struct(F.lit(i).alias("p"), F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).alias("b"))
    rest = _by_key(bits, lambda own: F.array(*[byte(i) for i in range(8) if i not in own]))
    return first.join(met, ["c", "v"]).select("fp", "copies", "c", "v", F.explode(rest).alias("k")).select("fp", "copies", "c", "v", "k.p", "k.b")


def tallied(pairs: DataFrame, bits: int = BITS) -> DataFrame:
    """The pairs (a, b) of `pairs` (c, a, b; one row per list they meet in) that share the guaranteed minimum
    of positional bytes: those of their key and one for each list."""
    needed = _by_key(bits, lambda own: F.lit(8 - bits - len(own)))
    return pairs.groupBy("c", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= needed).select("a", "b").distinct()


def near_fingerprints(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` of `nodes`, whose components are those of all
    pairs at most `bits` (0 to 6) bits apart. A list's hub is the fingerprint of the most `copies`."""
    if not 0 <= bits <= 6:
        raise ValueError("bits must be 0 to 6")
    if bits == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    if "copies" not in nodes.columns:
        nodes = nodes.withColumn("copies", F.lit(1).cast("long"))
    key = ["c", "v", "p", "b"]
    index = materialize(postings(nodes, bits), "index")
    lists = index.groupBy(*key).agg(F.count("*").alias("members"), F.max(F.struct("copies", "fp")).alias("hub")).filter("members > 1")
    listed = materialize(spread_join(index, materialize(lists, "lists"), key, "members").select("fp", *key, F.col("hub.fp").alias("hub")), "postings")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    stars = listed.filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    links = materialize(stars.filter((shared_bytes(F.col("a").bitwiseXOR(F.col("b"))) >= 8 - bits) & near("a", "b")), "links")
    split = unsettled(listed, components(links), "fp", key)
    x, y = split.filter("component <> major").alias("x"), split.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    met = x.join(y, (same[0] & same[1] & same[2] & same[3]) & _open("fp"))
    pairs = met.select("x.c", F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
    return links.union(tallied(pairs, bits).filter(near("a", "b")))


def _open(node: str) -> Column:
    """Each pair (x, y) of a list in different components once, x not in the largest one."""
    return (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col(f"x.{node}") < F.col(f"y.{node}")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits; the least id that is reachable."""
    fps = materialize(fingerprints(docs, size, text, key), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    found = components(near_fingerprints(nodes, bits))
    named = materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component")), "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = spread_join(named, materialize(ids, "ids"), ["component"]).select("fp", "copies", "component_id")
    return spread_join(fps, materialize(classes, "classes"), ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by shingle sets: the index of fingerprints finds the first pairs, a prefix filter the rest; the sets decide.

#: Buckets of the table that tells common shingles from rare ones.
BUCKETS = 1 << 20
#: Sizes of a band differ by this share.
BAND = 0.03
#: Bits that tell shingles found in several prefixes from the others.
SEEN = 1 << 27
#: Bytes of one of Spark's bitmaps; shingles of a prefix in one row.
BITMAP, CHUNK = 4096, 256


def _common(texts: DataFrame, size: int) -> np.ndarray:
    """How common the shingles of each bucket are, by the buckets that stand out in a task. The counts
    only set the order of shingles: any order finds the same pairs, a good one makes short lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            for t in batch.column("text").to_pylist():
                buckets = np.unique(shingle_hashes(space_words(t), size)) % np.uint64(BUCKETS)
                np.add.at(counts, buckets.astype(np.int64), 1)
        mean = counts.mean()
        found = np.flatnonzero(counts > max(1, mean + 2 * mean**0.5))
        for i in range(0, len(found), ROWS):
            part = found[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))], ["bucket", "n"])

    rows = texts.mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def met_fingerprints(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of `nodes` (node_id, fp; a written table) from the index of fingerprints: each node and the least one of its
    fingerprint, and the least ones of linked fingerprints."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("node_id").alias("hub"), F.count("*").alias("copies")), "fingerprints")
    equal = spread_join(nodes, prints.filter("copies > 1"), ["fp"], "copies").filter("node_id <> hub").select(F.col("hub").alias("a"), F.col("node_id").alias("b"))
    links = materialize(near_fingerprints(prints.select("fp", "copies"), bits), "near")
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("hub").alias(f"h{side}"))
    return equal.union(links.join(of("a"), "a").join(of("b"), "b").select(F.least("ha", "hb"), F.greatest("ha", "hb"))).distinct()


def _seen(keys: DataFrame) -> np.ndarray:
    """A bitmap of the places (mod `SEEN`) of the keys `k` that stand in several rows. Its size is fixed, so a large corpus fills it;
    a bit set in vain lets a row pass that is dropped later."""
    several = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select((F.pmod("k", F.lit(SEEN)) + 1).alias("p"))
    rows = several.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    out = np.zeros((SEEN // (8 * BITMAP), BITMAP), np.uint8)
    for i, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[i - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def parities(members: np.ndarray) -> bytes:
    """Whether each of 2**k bins (64 at least, else as many as members or up to twice that) holds an odd number of the set's 64-bit members."""
    width = 1 << max(6, (len(members) - 1).bit_length())
    return np.packbits(np.bincount((members % np.uint64(width)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def surely_apart(x: bytes, y: bytes) -> int:
    """How many members at least stand in one only of the two sets of these `parities`. The wider is folded to the other's bins."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _judged(slim: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, t, n, stays): which of the rows `slim` (doc_id, text, t: a hash of the text) stay; n are equal in both."""
    least = lambda n: F.ceil(similarity * n - 1e-9)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            h = [xxhash.xxh128_digest(b" ".join(space_words(t))) for t in texts]
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(h, pa.binary()), pa.array(fps)], ["doc_id", "t", "h", "fp"])

    prints = materialize(slim.mapInArrow(read, "doc_id long, t long, h binary, fp long"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    nodes = materialize(prints.groupBy("h").agg(first, F.min("fp").alias("fp")).select(F.monotonically_increasing_id().alias("node_id"), "first", "fp"), "nodes")

    def texts(wanted: DataFrame) -> DataFrame:
        """(node_id, text) of the nodes `wanted`; rows equal in id and text all come."""
        keys = bounded(wanted.select("node_id", F.col("first.doc_id").alias("i"), F.col("first.t").alias("u")))
        return slim.join(keys, slim["doc_id"].eqNullSafe(keys["i"]) & (slim["t"] == keys["u"])).select("node_id", "text")

    order = slim.sparkSession.sparkContext.broadcast(_common(texts(nodes), size))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids, ns, starts, ks, marks = [], [], [], [], []
            for i, t in zip(batch.column("node_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = np.unique(shingle_hashes(space_words(t), size))
                n = len(h)
                own = h[np.argsort(order.value[(h % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1]
                for start in range(0, len(own), CHUNK):
                    ids.append(i)
                    ns.append(n)
                    starts.append(start)
                    ks.append(own[start : start + CHUNK].view(np.int64))
                    marks.append(None if start else parities(h))
            if ids:
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ks)], dtype=np.int32), np.concatenate(ks))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(starts, pa.int32()), lists, pa.array(marks, pa.binary())], ["id", "n", "start", "ks", "mark"])

    held = materialize(texts(nodes).mapInArrow(prefixes, "id long, n int, start int, ks array<long>, mark binary"), "prefixes")
    order.destroy()
    # Most shingles of the prefixes stand in one only; rows are made of the others.
    seen = slim.sparkSession.sparkContext.broadcast(_seen(held.select(F.explode("ks").alias("k"))))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ks")).to_numpy(zero_copy_only=False).astype(np.int64)
            k = batch.column("ks").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = k % SEEN
            keep = np.flatnonzero(seen.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            place = keep - (np.cumsum(sizes) - sizes)[row] + batch.column("start").to_numpy()[row]
            own = [batch.column("id").to_numpy()[row], k[keep], batch.column("n").to_numpy()[row], place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], ["id", "k", "n", "place"])

    index = materialize(held.drop("mark").mapInArrow(shared, "id long, k long, n int, place int"), "shared")
    seen.destroy()
    # The hub of a list is the text with the fewest shingles rarer than the list's.
    lists = index.groupBy("k").agg(F.count("*").alias("members"), F.min(F.struct("place", "id", "n")).alias("hub")).filter("members > 1")
    listed = materialize(spread_join(index, materialize(lists, "lists"), ["k"], "members").select(*index.columns, "hub"), "postings")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            s = [np.unique(shingle_hashes(space_words(t), size)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(s, pa.binary())], ["id", "s"])

    def may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 - similarity) / (1 + similarity)
        for batch in batches:
            ends = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([surely_apart(x, y) <= most * (n + m) + 1e-6 for n, m, x, y in ends], pa.bool_()))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(likely: DataFrame) -> DataFrame:
        """The pairs (a, b) of `likely` that have the similarity."""
        likely = materialize(likely, "candidates")
        ends = lambda: likely.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
        # A text without words has no sketch and is similar to no other.
        marks = held.filter("start = 0").select("id", "n", "mark").join(bounded(ends()).withColumnRenamed("node_id", "id"), "id", "left_semi")
        marks = materialize(marks.groupBy("id").agg(F.min("n").alias("n"), F.min("mark").alias("m")), "marks")
        of_mark = lambda side: marks.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("m").alias(f"m{side}"))
        likely = materialize(likely.join(of_mark("a"), "a").join(of_mark("b"), "b").mapInArrow(may_be_alike, "a long, b long"), "likely")
        wanted = ends().join(nodes, "node_id")
        kept = materialize(texts(wanted).mapInArrow(sets, "id long, s binary").groupBy("id").agg(F.min("s").alias("s")), "sets")
        of_set = lambda side: kept.select(F.col("id").alias(side), F.col("s").alias(f"s{side}"))
        return materialize(likely.join(of_set("a"), "a").join(of_set("b"), "b").mapInArrow(alike, "a long, b long"), "links")

    # What two sets of n and m shingles must share, and can share at most if their first shared ones stand at i and j.
    fits = lambda n, i, m, j: (F.least(n, m) >= least(F.greatest(n, m))) & (F.least(n - i, m - j) >= F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))
    close = verified(met_fingerprints(nodes.select("node_id", "fp")))
    found = components(close)
    placed = bounded(found)
    within = lambda side: placed.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    spokes = listed.filter((F.col("id") != F.col("hub.id")) & fits(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place")))
    apart = spokes.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct().join(within("a"), "a", "left").join(within("b"), "b", "left")
    links = close.union(verified(apart.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")))
    found = components(links)
    # What the stars left open, by bands of sizes: a row looks only into those it can be similar to. Hubs have met all of their lists.
    split = unsettled(listed.filter(F.col("id") != F.col("hub.id")).drop("hub"), found, "id", ["k"])
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(1 + BAND))
    n, i = F.col("n"), F.col("place")
    low, high = F.greatest(least(n), F.lit(1)), F.least(F.floor(n / similarity + 1e-9), F.floor((n - i) * ((1 + similarity) / similarity) - n + 1e-6))
    x = split.filter("component <> major").withColumns({"low": low, "high": high}).filter("low <= high")
    x = x.withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high"))))).alias("x")
    y = split.withColumn("band", band(n)).alias("y")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.band") == F.col("y.band")) & _open("id") & fits(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")))
    rest = verified(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    if not rest.isEmpty():
        found = components(links.union(rest))
    named = nodes.join(found, nodes["node_id"] == found["node"], "left").select("first", F.coalesce("component", "node_id").alias("component"))
    stay = materialize(named.groupBy("component").agg(F.min("first").alias("m")).select(F.col("m.doc_id").alias("i"), F.col("m.t").alias("u")), "stay")
    keys = prints.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    on = keys["doc_id"].eqNullSafe(stay["i"]) & (keys["t"] == stay["u"])
    return materialize(keys.join(stay, on, "left").select("doc_id", "t", "n", F.col("u").isNotNull().alias("stays")), "judged", keep=True)


def near_texts(docs: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay: one of each group of texts linked by a Jaccard similarity of
    `similarity` or more of their sets of `size`-word shingles. Texts of equal words are copies.

    Candidates come from the index of fingerprints first (`met_fingerprints`). A prefix filter completes them: of n
    shingles in one order of all shingles, rare ones first, two such sets share one of their first
    n - ceil(similarity n) + 1, and where the first shared one stands tells how many they can share at most. A posting list is one shingle of these prefixes, with places; pairs whose
    sizes and places rule the similarity out are never made. A text with so many shingles of its
    own that nothing can be similar to it therefore meets no other text of its list.

    The row of the group's least id stays (null ids last, then by hashes of the texts); of rows equal
    in id and text any one stays.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("t"))
    with scratch(docs.sparkSession):
        judged = _judged(slim, size, similarity)
    gone = judged.filter(~F.col("stays")).select(F.col("doc_id").alias("_gi"), F.col("t").alias("_gt"))
    again = judged.filter("stays and n > 1").select(F.col("doc_id").alias("_gi"), F.col("t").alias("_gt"))
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(key).cast("long").alias("_i"), F.xxhash64(body).alias("_t"))
    same = lambda k: rows["_i"].eqNullSafe(k["_gi"]) & (rows["_t"] == k["_gt"])
    kept = rows.join(bounded(gone), same(gone), "left_anti")
    if not again.isEmpty():
        once = kept.join(bounded(again), kept["_i"].eqNullSafe(again["_gi"]) & (kept["_t"] == again["_gt"]), "left_semi").dropDuplicates(["_i", "_t"])
        kept = kept.join(bounded(again), kept["_i"].eqNullSafe(again["_gi"]) & (kept["_t"] == again["_gt"]), "left_anti").union(once)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])
