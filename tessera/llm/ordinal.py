"""Quality classifier (7): ordinal cumulative-link regression on graded ratings.

A document's grade runs from 0 to K - 1. One weight vector over hashed text features and ordered
thresholds give P(grade > k) = sigmoid(w x - t_k), and from it the expected grade and the tail
probability by which documents are selected. Features of a text are those of its distinct words
(the word, two prefixes, its shape), hashed to `DIM` places and divided by the root of the number
of distinct words, and bands of four figures of the whole text (words, distinct words against all,
words without a letter or digit, word length).

The likelihood is maximised by L-BFGS over features of equal variance; those of fewer than
`LEAST` sampled texts are left out. Rows of a bounded sample of the labelled documents (about
`SAMPLE` rows, drawn by a hash) are packed into sparse blocks in shared storage; each step is a
Spark job in which tasks sum the gradient over their blocks, and the driver adds one vector per task, of the features left in (`DIM` at most). Prediction reads whole texts of all rows.

Cases: null and wordless texts score w x = 0; null ratings aren't learned from; several ratings of
a document count each; with no rated document all weights are zero and the thresholds select
every row; repeated rows are judged each for itself; empty tables give no rows; other columns pass
in the struct `row`, clashing names included; very long texts are whole batches of their own; ties of
the selection bound are selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import small_batches
from tessera.sources.joins import bounded
from tessera.sources.storage import materialize

DIM = 1 << 17
SAMPLE = 12_000
STEPS = 50
RIDGE = 1e-4
LEAST = 5
#: Added to a feature's mean square, so that rare ones aren't blown up.
FLOOR = 5e-3
SELECT = 0.7
BATCH_BYTES = 1 << 20
#: Tasks of a step at most: the sample is bounded, and each sends the driver one vector.
TASKS = 24
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _features(word: str) -> tuple[int, ...]:
    core = word.strip(_EDGE)
    low = core.lower()
    tail = word[len(word.rstrip(_EDGE)) :]
    shape = f"{tail[:3]}|{'U' if core.isupper() and len(core) > 1 else ''}|{'d' if any(map(str.isdigit, core)) else ''}|{'' if core else word[:3]}"
    h = xxhash.xxh64_intdigest
    return tuple(h(x, s) % DIM for s, x in enumerate((low, low[:4] + "\x01", low[:5] + "\x02", shape)))


def sparse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word number) of each document's distinct words, features of the words (words, 4),
    the number of distinct words of each document, and features of its figures (documents, 4)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    docs = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if words and "" in words:
        keep = codes != words.index("")
        docs, codes = docs[keep], codes[keep]
    n, k = len(texts), max(1, len(words))
    total = np.bincount(docs, minlength=n)
    length = np.array([len(w) for w in words] or [0])
    bare = np.array([not any(map(str.isalnum, w)) for w in words] or [False])
    mean = lambda x: np.bincount(docs, x[codes], n) / np.maximum(total, 1)
    chars, marks = mean(length), mean(bare)
    pairs = np.unique(docs * k + codes)
    docs, codes = pairs // k, pairs % k
    distinct = np.bincount(docs, minlength=n)
    size = np.log2(total + 1).astype(np.int64)
    bands = [size, size * 100 + (20 * distinct / np.maximum(total, 1)).astype(np.int64), np.ceil(20 * marks).astype(np.int64), (2 * chars).astype(np.int64)]
    figures = np.stack([(b * 7919 + 104729 * (i + 1)) % DIM for i, b in enumerate(bands)], 1)
    features = np.array([_features(w) for w in words], np.int64).reshape(-1, 4)
    return docs, codes, features, distinct, figures


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, select: float = SELECT):
        self.weights, self.thresholds, self.select = weights.astype(np.float32), thresholds, select

    def scores(self, texts: pa.Array) -> np.ndarray:
        docs, codes, features, n, figures = sparse(texts)
        words = self.weights[features].sum(1).astype(np.float64)
        s = np.bincount(docs, words[codes], len(texts)) / np.sqrt(np.maximum(n, 1))
        return np.where(n > 0, s + self.weights[figures].sum(1), 0.0)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. K - 2, as (rows, K - 1)."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -50, 50)))


def _gradient(idx: np.ndarray, val: np.ndarray, ptr: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of a block and its derivatives by weights and thresholds."""
    row = np.repeat(np.arange(len(y)), np.diff(ptr))
    s = np.bincount(row, val * w[idx], len(y))
    ends = np.concatenate([[-np.inf], t, [np.inf]])
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    low, high = ends[y] - s, ends[y + 1] - s
    p_low, p_high = np.where(np.isinf(low), 0.0, sig(low)), np.where(np.isinf(high), 1.0, sig(high))
    p = np.maximum(p_high - p_low, 1e-12)
    f_low, f_high = p_low * (1 - p_low), p_high * (1 - p_high)
    g_s = (f_high - f_low) / p
    g_t = np.zeros(len(t) + 2)
    np.add.at(g_t, y, f_low / p)
    np.add.at(g_t, y + 1, -f_high / p)
    return float(-np.log(p).sum()), np.bincount(idx, val * g_s[row], len(w)), g_t[1:-1]


def _blocks(rows: DataFrame) -> DataFrame:
    """Sparse blocks (CSR arrays) of (text, grade) rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "text", BATCH_BYTES):
                docs, codes, features, n, figures = sparse(part.column("text"))
                root, rows = 1 / np.sqrt(np.maximum(n, 1)), np.flatnonzero(n)
                key = np.concatenate([(docs[:, None] * DIM + features[codes]).ravel(), (rows[:, None] * DIM + figures[rows]).ravel()])
                value = np.concatenate([np.repeat(root[docs], 4), np.ones(4 * len(rows))])
                key, back = np.unique(key, return_inverse=True)
                val, d = np.bincount(back, value, len(key)), key // DIM
                ptr = np.searchsorted(d, np.arange(part.num_rows + 1))
                y = part.column("grade").to_numpy(zero_copy_only=False)
                a = [(key % DIM).astype(np.int32).tobytes(), val.astype(np.float32).tobytes(), ptr.astype(np.int64).tobytes(), y.astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in a], ["idx", "val", "ptr", "y"])

    return rows.select("text", "grade").mapInArrow(work, "idx binary, val binary, ptr binary, y binary")


def _moments(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each feature, and its sum of squares."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, sq = np.zeros(DIM), np.zeros(DIM)
        for batch in batches:
            for idx, val in zip(batch.column("idx").to_pylist(), batch.column("val").to_pylist(), strict=True):
                i, v = np.frombuffer(idx, np.int32), np.frombuffer(val, np.float32)
                df, sq = df + np.bincount(i, minlength=DIM), sq + np.bincount(i, v * v, DIM)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (df, sq)], ["df", "sq"])

    df, sq = np.zeros(DIM), np.zeros(DIM)
    for r in blocks.select("idx", "val").mapInArrow(work, "df binary, sq binary").collect():
        df, sq = df + np.frombuffer(bytes(r["df"]), np.float32), sq + np.frombuffer(bytes(r["sq"]), np.float32)
    return df, sq


def _scaled(blocks: DataFrame, scale: np.ndarray) -> DataFrame:
    """The blocks without the features of scale 0; others are multiplied by it and numbered anew without gaps, so
    that the vectors of a step hold them alone."""
    shared = blocks.sparkSession.sparkContext.broadcast((scale, (np.cumsum(scale > 0) - 1).astype(np.int32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, val, ptr, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, v, p = np.frombuffer(idx, np.int32), np.frombuffer(val, np.float32), np.frombuffer(ptr, np.int64)
                scale, number = shared.value
                keep = scale[i] > 0
                new = np.concatenate([[0], np.cumsum(keep)])[p]
                a = [number[i[keep]].tobytes(), (v[keep] * scale[i[keep]]).astype(np.float32).tobytes(), new.astype(np.int64).tobytes(), y]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in a], ["idx", "val", "ptr", "y"])

    return blocks.mapInArrow(work, "idx binary, val binary, ptr binary, y binary")


def _job(blocks: DataFrame, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and gradient over all blocks: each task adds up its own."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, t))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        loss, gw, gt = 0.0, np.zeros(len(w)), np.zeros(len(t))
        for batch in batches:
            for idx, val, ptr, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = _gradient(np.frombuffer(idx, np.int32), np.frombuffer(val, np.float32), np.frombuffer(ptr, np.int64), np.frombuffer(y, np.int64), w, t)
                loss, gw, gt = loss + got[0], gw + got[1], gt + got[2]
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gw.astype(np.float32).tobytes()], pa.binary()), pa.array([gt.tobytes()], pa.binary())], ["loss", "gw", "gt"])

    loss, gw, gt = 0.0, np.zeros(len(w)), np.zeros(len(t))
    for r in blocks.mapInArrow(work, "loss double, gw binary, gt binary").collect():
        loss, gw, gt = loss + r["loss"], gw + np.frombuffer(bytes(r["gw"]), np.float32), gt + np.frombuffer(bytes(r["gt"]))
    shared.unpersist()
    return loss, gw, gt


def fit(docs: DataFrame, labels: DataFrame, grade: Column, grades: int = 3, sample: int = SAMPLE, steps: int = STEPS, ridge: float = RIDGE, text: str = "text", key: str = "doc_id", label_key: str = "doc_id") -> Model:
    """Learn from about `sample` rated documents. `grade`: an expression over `labels`, 0 .. grades - 1."""
    rated = labels.select(F.col(label_key).alias("_k"), grade.cast("int").alias("grade")).filter("_k is not null and grade is not null")
    n = rated.count()
    default = Model(np.zeros(DIM), np.arange(grades - 1) - float(grades))
    if not n:
        return default
    drawn = F.pmod(F.xxhash64("_k", "grade", F.lit(11)), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000
    rated = rated.filter(drawn)
    texts = docs.select(F.col(key).alias("_d"), F.col(text).cast("string").alias("text"))
    rows = texts.join(bounded(materialize(rated, "marks")), F.col("_d") == F.col("_k")).select("text", "grade")
    blocks = materialize(_blocks(rows), "rated").coalesce(TASKS)
    free = lambda x: (x[: -grades + 1], np.cumsum(np.concatenate([x[-grades + 1 : -grades + 2], np.exp(np.clip(x[len(x) - grades + 2 :], -8, 8))])))
    df, sq = _moments(blocks)
    total = max(1, blocks.select(F.sum(F.length("y") / 8)).first()[0] or 1)
    scale = np.where(df >= LEAST, 1 / np.sqrt(sq / total + FLOOR), 0.0)
    blocks = materialize(_scaled(blocks, scale), "rated").coalesce(TASKS)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = free(x)
        value, gw, gt = _job(blocks, w, t)
        back = np.cumsum(gt[::-1])[::-1].copy()  # a gap moves all thresholds above it
        back[1:] *= np.exp(np.clip(x[len(x) - grades + 2 :], -8, 8))
        return value / total + ridge * float(w @ w) / 2, np.concatenate([gw / total + ridge * w, back / total])

    live = np.flatnonzero(scale)
    x = np.concatenate([np.zeros(len(live)), [-1.0 * (grades - 1)], np.zeros(grades - 2)])
    w, t = free(lbfgs(loss, x, steps))
    weights = np.zeros(DIM)
    weights[live] = w * scale[live]
    return Model(weights, t)


def lbfgs(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    evaluations = 1
    while evaluations < steps and float(np.abs(g).max()) > 1e-7:
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(float(np.linalg.norm(g)), 1e-12)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0, -float(g @ q)
        while True:
            new = x - step * q
            there, h = loss(new)
            evaluations += 1
            if there <= value + 1e-4 * step * slope or step < 1e-3:
                break
            step /= 2
        if there > value:
            break
        if (new - x) @ (h - g) > 1e-12:
            past = [*past[-memory + 1 :], (new - x, h - g)]
        x, value, g = new, there, h
    return x


def grade_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row (the document's columns), expected_grade, p_top, p_above_worst, selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text)], ["row", "text"])
            for part in small_batches(iter([flat]), "text", BATCH_BYTES):
                tails = shared.value.tails(shared.value.scores(part.column("text")))
                columns = [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, 0]), pa.array(tails[:, -1] >= shared.value.select)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", "expected_grade", "p_top", "p_above_worst", "selected"])

    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, expected_grade double, p_top double, p_above_worst double, selected boolean")


def passed(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grade of a rating: how many of the two tests it passed (of quality, not toxic)."""
    return F.col(quality).cast("int") + 1 - F.col(toxic).cast("int")
