"""Cross-tokenizer alignment (13): merge-path partitioning of the token ends of two tokenizers.

A text is encoded by a byte-level tokenizer A and a piece tokenizer B. Both cover the same bytes, so
their tokens are two ascending lists of byte ends. Where an end stands in both lists, a group closes:
the tokens of A and of B since the last such end cover the same bytes, and the two tokens that end
there are linked. The lists are merged along the merge path: cutting it by diagonals at every
`PIECE` steps, each found by a binary search, gives pieces of equal work that don't depend on each other. Each
emits the ends that its two slices share; an end whose two tokens fall on either side of a diagonal is
found when neighbouring pieces are stitched, as are groups that run over several pieces. A batch's texts
are laid end to end, so pieces are equal whatever the lengths of the texts.

Linked tokens end at the same byte, so the bytes of one are a suffix of the other's. That bounds the
linked pairs of ids by the two vocabularies alone, under half a million here: `Vocabularies.pairs` lists
them, and counts and maxima over the whole corpus are one array of that length, whatever the corpus holds.

Cases: null and empty texts and texts whose joined bytes of either side differ from space + text have
no tokens: zeros and an empty hash; repeated rows and ids are aligned each for itself and all count;
ties for a B id's highest count are all best; very long texts make more pieces; an empty table gives no
rows; columns other than the two named aren't read, clashing names included.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import small_batches
from tessera.sources.storage import materialize

#: Steps of the merge path in a piece; bytes of text that a task works on at a time.
PIECE, BATCH_BYTES = 1 << 16, 1 << 20
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, links array<int>, groups_sha256 string, groups string"


class Tokenizers(NamedTuple):
    """Files of A (rank list with the splitting `pattern`, or a tokenizers file) and B (a piece model)."""

    a: str
    b: str
    pattern: str = ""


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both encoders, the bytes of all their ids, and the pairs of ids that can end together."""

    def __init__(self, files: Tokenizers):
        import sentencepiece

        if files.a.endswith(".tiktoken"):
            import tiktoken

            with open(files.a, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode_a = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            of_a = {i: t for t, i in ranks.items()}
        else:
            from tokenizers import Tokenizer

            model_a, alphabet = Tokenizer.from_file(files.a), _byte_alphabet()
            model_a.encode_special_tokens = True
            self.encode_a = lambda text: model_a.encode(text, add_special_tokens=False).ids
            of_a = {i: bytes(alphabet[c] for c in t) for t, i in model_a.get_vocab(with_added_tokens=True).items() if all(c in alphabet for c in t)}
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        piece = lambda i: self.model_b.id_to_piece(i)
        self.bytes_a = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.model_b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model_b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        ids = [{}, {}]
        for own, table in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
            for i, t in enumerate(table):
                own.setdefault(t, []).append(i)
        found = {(a, b) for a, t in enumerate(self.bytes_a) for k in range(len(t)) for b in ids[1].get(t[k:], ())}
        found |= {(a, b) for b, t in enumerate(self.bytes_b) for k in range(1, len(t)) for a in ids[0].get(t[k:], ())}
        #: Sorted (a << 32 | b) of all pairs that can be linked; a link is named by its place here.
        self.pairs = np.array(sorted(a << 32 | b for a, b in found), np.int64)
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.top = top
        self.written = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(top)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides; none for a text that either side doesn't give back."""
        left, right = [], []
        for text, b in zip(texts, self.model_b.encode(texts, num_threads=1), strict=True):
            data = (" " + text).encode()
            a = self.encode_a(" " + text) if text and b"".join(map(self.bytes_b.__getitem__, b)) == data else []
            whole = a and int(self.sizes_a[a].sum()) == len(data) and b"".join(map(self.bytes_a.__getitem__, a)) == data
            left.append(a if whole else [])
            right.append(b if whole else [])
        return left, right


@lru_cache(maxsize=2)
def vocabularies(files: Tokenizers) -> Vocabularies:
    return Vocabularies(files)


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of ascending `a` and `b` crosses every `step`-th diagonal: so many of `a` and of `b`
    come before. At equal ends `a` goes first. All diagonals are searched at once."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, step), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        first = a[mid] <= b[d[open_] - 1 - mid]
        low[open_[first]] = mid[first] + 1
        high[open_[~first]] = mid[~first]
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the slices `a` and `b` of one piece whose ends are equal."""
    at = np.searchsorted(b, a)
    inside = np.flatnonzero(at < len(b))
    same = inside[b[at[inside]] == a[inside]]
    return same, at[same]


def common_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places of all equal ends: of each piece, and between the last of `a` before a diagonal and the first of `b` after it."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = diagonals(a, b, step)
    left, right = [], []
    for p in range(len(i) - 1):
        x, y = overlaps(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]])
        left.append(x + i[p])
        right.append(y + j[p])
        if i[p + 1] and j[p + 1] < len(b) and a[i[p + 1] - 1] == b[j[p + 1]]:
            left.append(i[p + 1 : p + 2] - 1)
            right.append(j[p + 1 : p + 2])
    return np.concatenate(left), np.concatenate(right)


def _starts(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def align_texts(texts: list[str], own: Vocabularies, step: int = PIECE, written: bool = False) -> list[tuple]:
    """For each text: numbers of tokens, groups and links; its links; the hash of its groups, and the groups themselves if `written`."""
    ids_a, ids_b = own.encode(texts)
    starts_a, starts_b = _starts(list(map(len, ids_a))), _starts(list(map(len, ids_b)))
    a, b = (np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in ids if x]]) for ids in (ids_a, ids_b))
    at_a, at_b = common_ends(np.cumsum(own.sizes_a[a]), np.cumsum(own.sizes_b[b]), step)
    links = np.searchsorted(own.pairs, a[at_a] << 32 | b[at_b]).astype(np.int32)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[at_a], last_b[at_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # A group's tokens of A stand before its tokens of B.
    codes = np.zeros(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = a + own.top * last_a
    codes[np.arange(len(b)) + (at_a + 1)[group_b]] = b + 2 * own.top * last_b
    bounds = np.searchsorted(at_a, starts_a)
    out = []
    for k in range(len(texts)):
        n_a, n_b, n = (int(x[k + 1] - x[k]) for x in (starts_a, starts_b, bounds))
        text = b"".join(map(own.written.__getitem__, codes[starts_a[k] + starts_b[k] : starts_a[k + 1] + starts_b[k + 1]].tolist()))[:-1]
        digest = hashlib.sha256(text).hexdigest() if n_a else ""
        out.append((n_a, n_b, n, n, links[bounds[k] : bounds[k + 1]], digest, text.decode() if written else None))
    return out


def align(docs: DataFrame, files: Tokenizers, text: str = "text", key: str = "doc_id", step: int = PIECE, written: bool = False) -> DataFrame:
    """One row per document: numbers, `links` (places in `Vocabularies.pairs`, in order), `groups_sha256` and, if
    `written`, the groups as `a1,a2|b1;a3|b2,b3` with decimal ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(files)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows = align_texts([t or "" for t in batch.column("text").to_pylist()], own, step, written)
            n_a, n_b, groups, n, links, digests, texts = zip(*rows, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(_starts(list(map(len, links))), pa.int32()), pa.array(np.concatenate(links)))
            numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, lists, pa.array(digests), pa.array(texts, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256", "groups"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, ALIGNED)


def link_counts(aligned: DataFrame, pairs: int) -> DataFrame:
    """(link, n): how often each linked pair occurs. Each task adds its own up first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(pairs, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("links").flatten().to_numpy(), minlength=pairs)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["link", "n"])

    return aligned.select("links").mapInArrow(work, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))


def align_corpus(docs: DataFrame, files: Tokenizers, text: str = "text", key: str = "doc_id", written: bool = False) -> DataFrame:
    """`align` with `n_best` (links whose count is their B id's highest in the corpus) and `count_sum`. The table of
    alignments is written once; the counts, bounded by the vocabularies, go to all tasks."""
    aligned = materialize(align(docs, files, text, key, written=written), "aligned")
    pairs = vocabularies(files).pairs
    found = link_counts(aligned, len(pairs)).toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[found.column("link").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(int((pairs & 0xFFFFFFFF).max()) + 1, np.int64)
    np.maximum.at(highest, pairs & 0xFFFFFFFF, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[pairs & 0xFFFFFFFF]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            lists = batch.column("links")
            links = lists.flatten().to_numpy()
            ends = _starts(np.diff(lists.offsets.to_numpy()))
            sums = [pa.array(np.diff(_starts(x[links])[ends])) for x in (best, counts)]
            kept = [c for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *sums], [*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(work, ALIGNED.replace(" links array<int>,", "") + ", n_best long, count_sum long")
