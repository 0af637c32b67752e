import random

import numpy as np
from pyspark.sql import Row

from tessera.llm import decontam
from tessera.llm.words import alnum_words


def brute(texts, items, window=13):
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i) if i is not None else "")
    out = []
    for t in texts:
        w, hit, ids = alnum_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((len(w), len(hit), sorted(ids)))
    return out


def sample(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "Ä", "ß1", "the", "x9"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 13, 14, 20])))) for i in range(12)] + [(3, None), (None, "a b a b a"), (77, "a b a b a")]
    texts = [None, "", "  ,;", "zz " * 50]
    for _ in range(60):
        t = [word() for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.6:
            t[len(t) // 2 : len(t) // 2] = (rnd.choice(items)[1] or "").split() * rnd.choice([1, 2])
        texts.append(rnd.choice([" ", ", ", "\n"]).join(t))
    return texts + texts[-3:], items


def test_against_brute_force(spark):
    for seed, block in ((1, 8 << 20), (2, 120)):
        texts, items = sample(seed)
        docs = spark.createDataFrame([Row(doc_id=i, text=t, n_words="x", spans=1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, spans int").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        found = decontam.judged(decontam.find(docs, bench, block_bytes=block, shard_words=300)).collect()
        got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found}
        assert [got[i] for i in range(len(texts))] == brute(texts, items)
        assert all(r["row"]["n_words"] == "x" and r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in found)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.find(docs.limit(0), bench).count() == 0
    assert [(r["n_words"], r["spans"]) for r in decontam.find(docs, bench.limit(0)).collect()] == [(2, [])]


def test_suffix_array_and_ranks():
    rnd = np.random.default_rng(3)
    values = rnd.integers(0, 9, 500)
    w = decontam.Wavelet(values, 4)
    i = rnd.integers(0, 501, 200)
    for c in range(10):
        assert (w.rank(np.full(200, c), i) == [(values[:k] == c).sum() for k in i]).all()
    c, before = w.access_rank(np.arange(500))
    assert (c == values).all() and (before == [(values[:k] == values[k]).sum() for k in range(500)]).all()


def test_cut_spans():
    assert decontam.cut_spans("One, two; Drei vier. Fünf", [(1, 2)]) == "One,  vier. Fünf"
