"""Language ID (6): interpolated Kneser-Ney character models, one per language.

Every character of a word is predicted from the `ORDER` - 1 before it (word starts are padded),
interpolated down to single characters with continuation counts. A language's n-grams are held in
sorted arrays of 64-bit hashes. A text takes the language of the lowest cross-entropy per
character over all of its words; the score is the calibrated probability that this is right, and
texts that score under `REJECT` are marked as not accepted.

Models are fitted on a bounded sample: rows of each language are drawn by a hash of text and id
so that about `TRAIN_CHARS` characters are expected of each; a fifth of these rows calibrates the
score. Everything else reads whole texts of all rows.

Cases: `und` with score 0 if the text is null or has no letter, or if nothing could be learned;
ties go to the language first in order; repeated rows are judged each for itself; empty tables
give no rows; other columns pass in the struct `row`, clashing names included; very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import small_batches

ORDER = 4
TRAIN_CHARS = 3_000_000
REJECT = 0.5
START, END = "\x02", "\x03"
UND = "und"
BATCH_BYTES = 3 << 20
OUT = "lang_pred string, score double, accepted boolean, bits_per_char double, margin double, n_letters_words long"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, word number) of every word, and the distinct words: lower case, split at white space."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    docs = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    codes = flat.indices.to_numpy(zero_copy_only=False)
    words = flat.dictionary.to_pylist()
    letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
    keep = letters[codes] if len(codes) else np.zeros(0, bool)
    return docs[keep], codes[keep], words


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the padded words: (hash of the last k characters at each predicted
    place, for k = 0 .. order), the same for the contexts before them, and each place's word."""
    joined = "".join(START * (order - 1) + w + END for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + order for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(inside >= order - 1)
    with np.errstate(over="ignore"):
        grams, contexts = [np.zeros(len(at), np.uint64)], [np.zeros(len(at), np.uint64)]
        for k in range(1, order + 1):
            grams.append(_fold(grams[-1], chars[at - (k - 1)], k))
            if k < order:
                contexts.append(_fold(contexts[-1], chars[at - k], k))
    return np.stack(grams), np.stack(contexts), word[at]


def _fold(h: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Hash of a string of k characters read backwards, from the hash of its last k - 1."""
    x = (h ^ (c + np.uint64(k << 32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Model:
    """One language: per order, sorted hashes of n-grams with their discounted shares, and of
    contexts with the weight of the lower order."""

    def __init__(self, counts: dict[str, int], order: int):
        self.order, self.tables, self.weights = order, [], []
        level, alphabet = dict(counts), len({g[-1] for g in counts}) + 1
        for k in range(order, 0, -1):
            once = sum(c == 1 for c in level.values())
            twice = sum(c == 2 for c in level.values())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total, kinds = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.tables.append(self._sorted({g: (c - discount) / total[g[:-1]] for g, c in level.items()}, k))
            self.weights.append(self._sorted({h: discount * kinds[h] / total[h] for h in total}, k - 1))
            level = Counter(g[1:] for g in level)
        self.floor = 1.0 / alphabet
        self.tables.reverse()
        self.weights.reverse()

    @staticmethod
    def _sorted(values: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        keys = list(values)
        h = np.zeros(len(keys), np.uint64)
        if k:
            chars = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, k)
            with np.errstate(over="ignore"):
                for j in range(1, k + 1):
                    h = _fold(h, chars[:, k - j], j)
        order = np.argsort(h)
        return h[order], np.array(list(values.values()), np.float64)[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        hashes, values = table
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where(hashes[at] == keys, values[at], missing)

    def bits(self, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """-log2 p of each predicted character."""
        p = np.full(grams.shape[1], self.floor)
        for k in range(1, self.order + 1):
            p = self._find(self.tables[k - 1], grams[k], 0.0) + self._find(self.weights[k - 1], contexts[k - 1], 1.0) * p
        return -np.log2(p)


class Scorer:
    """All languages' models and the calibration of the score."""

    def __init__(self, models: dict[str, Model], order: int, slope: float = 1.0, shift: float = 0.0):
        self.langs, self.models, self.order, self.slope, self.shift = sorted(models), models, order, slope, shift

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character of each text in each language; its characters and its words with a letter."""
        docs, codes, words = _words(texts)
        n = len(texts)
        if not len(codes) or not self.langs:
            return np.zeros((n, len(self.langs))), np.zeros(n), np.bincount(docs, minlength=n)
        used, codes = np.unique(codes, return_inverse=True)
        grams, contexts, word = _grams([words[i] for i in used.tolist()], self.order)
        _, first, back = np.unique(grams[-1], return_index=True, return_inverse=True)
        chars = np.bincount(word)
        sums = [np.bincount(word, self.models[x].bits(grams[:, first], contexts[:, first])[back]) for x in self.langs]
        length = np.bincount(docs, chars[codes], n)
        total = np.stack([np.bincount(docs, s[codes], n) for s in sums], 1)
        return total / np.maximum(length, 1)[:, None], length, np.bincount(docs, minlength=n)

    @staticmethod
    def evidence(margin: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The lead in bits per character counts more on longer texts."""
        return margin * np.sqrt(np.clip(chars, 1, 400))

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        bits, chars, words = self.entropies(texts)
        n = len(texts)
        if not self.langs:
            zeros = pa.array(np.zeros(n))
            return [pa.array([UND] * n), zeros, pa.array([False] * n), zeros, zeros, pa.array(words, pa.int64())]
        ranked = np.sort(bits, 1)
        margin = ranked[:, 1] - ranked[:, 0] if len(self.langs) > 1 else np.ones(n)
        score = np.where(words > 0, 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(margin, chars) + self.shift, -50, 50))), 0.0)
        names = np.array(self.langs, object)[bits.argmin(1)]
        names[words == 0] = UND
        return [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(score >= REJECT), pa.array(ranked[:, 0]), pa.array(margin), pa.array(words, pa.int64())]


def _calibrate(right: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Logistic fit of being right on the evidence, by Newton steps with smoothed targets."""
    if not len(x):
        return 1.0, 0.0
    n1, n0 = right.sum(), (~right).sum()
    t = np.where(right, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(x)), 1e-6)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, a.T @ (t - p) - 1e-3 * w), -2, 2)
    return max(float(w[0] / scale), 0.0), float(w[1])


def fit(train: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, train_chars: int = TRAIN_CHARS, key: str = "doc_id") -> Scorer:
    """Learn from a sample of `train` of about `train_chars` characters a language."""
    rows = train.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    share = F.create_map(*[F.lit(y) for x, n in sizes.items() for y in (x, min(1.0, train_chars / max(n, 1)))]) if sizes else None
    if share is None:
        return Scorer({}, order)
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    part = F.pmod(F.xxhash64("text", "key", F.lit(1)), F.lit(5))
    sample = rows.filter(drawn).withColumn("part", part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[str, Counter] = {}
            langs = np.array(batch.column("lang").to_pylist(), object)
            docs, codes, words = _words(batch.column("text"))
            for x in set(langs.tolist()):
                own = np.bincount(codes[langs[docs] == x], minlength=len(words))
                c = got.setdefault(x, Counter())
                for i in np.flatnonzero(own).tolist():
                    padded, m = START * (order - 1) + words[i] + END, int(own[i])
                    for j in range(len(padded) - order + 1):
                        c[padded[j : j + order]] += m
            out = [(x, g, n) for x, c in got.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], ["lang", "gram", "n"]
            )

    grams = sample.filter("part > 0").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in grams.toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    scorer = Scorer({x: Model(c, order) for x, c in counts.items()}, order)
    if len(scorer.langs) < 2:
        return scorer
    shared = train.sparkSession.sparkContext.broadcast(scorer)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(right, evidence) of each text, and once more with its own language left out."""
        for batch in batches:
            own = shared.value
            for part in small_batches(iter([batch]), "text", BATCH_BYTES):
                bits, chars, words = own.entropies(part.column("text"))
                langs = np.array(own.langs, object)
                true = np.array(part.column("lang").to_pylist(), object)
                right, x = [], []
                for without in (False, True) if len(langs) > 2 else (False,):
                    b = np.where((langs[None, :] == true[:, None]) & without, np.inf, bits)
                    two = np.sort(b, 1)
                    right.append((langs[b.argmin(1)] == true)[words > 0])
                    x.append(own.evidence(two[:, 1] - two[:, 0], chars)[words > 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(right)), pa.array(np.concatenate(x))], ["right", "x"])

    got = sample.filter("part = 0").select("lang", "text").mapInArrow(held, "right boolean, x double").toPandas()
    scorer.slope, scorer.shift = _calibrate(got["right"].to_numpy(bool), got["x"].to_numpy(float))
    return scorer


def predict(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """row (the document's columns), lang_pred, score, accepted, bits_per_char, margin."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text)], ["row", "text"])
            for part in small_batches(iter([flat]), "text", BATCH_BYTES):
                names = ["row", *(x.split()[0] for x in OUT.split(", "))]
                yield pa.RecordBatch.from_arrays([part.column("row"), *shared.value.predict(part.column("text"))], names)

    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, {OUT}")


def held_out(key: Column, parts: int, which: int) -> Column:
    """crc32 of the id as text, modulo `parts`, is `which`; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == which, F.lit(False))
