import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kneser_ney as kn


class Brute:
    """The same model from plain dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.levels = {order: Counter()}
        self.raw = Counter()
        for t in texts:
            w = self.words(t)
            self.raw.update(w)
            padded = ["<s>"] * (order - 1) + w
            for i in range(len(w)):
                self.levels[order][tuple(padded[i : i + order])] += 1
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.d = {}
        for k, c in self.levels.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            self.d[k] = [min(max(x, 0.05), j + 0.95) for j, x in enumerate(d)]

    @staticmethod
    def words(t):
        return [w.decode() for w in kn_words(t)] + ["</s>"]

    def p(self, h, w):
        k = len(h) + 1
        low = self.p(h[1:], w) if h else 1 / (len(self.raw) + 1)
        own = {g: c for g, c in self.levels[k].items() if g[:-1] == h}
        total = sum(own.values())
        if not total:
            return low
        d = self.d[k]
        c = own.get((*h, w), 0)
        gamma = sum(d[min(x, 3) - 1] for x in own.values()) / total
        return (c - (d[min(c, 3) - 1] if c else 0)) / total + gamma * low

    def score(self, t):
        w = self.words(t)
        padded = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), w[i])) for i in range(len(w)))


def kn_words(t):
    from tessera.llm.words import space_words

    return space_words(t)


def sample(seed, n=60):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(["the", "The", "Äx", "b,", "c d", "e"]) for _ in range(rnd.randrange(30))) for _ in range(n)]
    return [None, "", " \n\t ", "x\x1cy z", *texts, texts[0]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    learn, rest = sample(1), [*sample(2), "never seen words"]
    docs = spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string").repartition(3)
    model = kn.train(docs, order, buckets=5)
    brute = Brute(learn, order)
    assert model.total == sum(brute.raw.values()) and model.types == len(brute.raw)
    rows = kn.score(spark.createDataFrame(list(enumerate(rest)), "doc_id long, text string"), model).collect()
    for r in rows:
        t = rest[r["row"]["doc_id"]]
        w = brute.words(t)
        base = sum(math.log10((brute.raw[x] + 0.5) / (model.total + 0.5 * (model.types + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in brute.raw for x in w))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(brute.score(t))


def test_probabilities_sum_to_one(spark):
    model = kn.train(spark.createDataFrame([(t,) for t in sample(3)], "text string"), 2, buckets=3)
    vocabulary, _ = kn.tokens(pa.array([t for t in sample(3) if t]))
    words = np.unique(vocabulary)
    for context in itertools.chain(words[:4], [np.uint64(999)]):
        grams = [np.full(len(words) + 1, context, np.uint64), np.append(words, np.uint64(12345))]
        assert (10 ** model.log_probs(grams)).sum() == pytest.approx(1)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kn.train(empty)
    assert kn.score(empty, model).count() == 0
    rows = kn.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in rows] == [(3, 0, 0.0)]


def test_distinct_rows_beyond_one_key():
    rnd = np.random.default_rng(1)
    codes = [rnd.integers(0, 4, 500).astype(np.uint32) for _ in range(3)]
    ones = [np.ones(500, np.int64)]
    small, n = kn._distinct(codes, 4)
    for size in (4, 1 << 30):
        large, m = kn._distinct(codes, size, ones)
        assert np.array_equal(np.stack(small), np.stack(large)) and np.array_equal(n[0], m[0])
    want = Counter(zip(*(c.tolist() for c in codes), strict=True))
    assert {tuple(r): c for r, c in zip(np.stack(small, 1).tolist(), n[0].tolist(), strict=True)} == want
