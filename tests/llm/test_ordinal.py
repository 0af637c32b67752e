import random

import numpy as np
import pyarrow as pa

from tessera.llm import ordinal


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    idx, val, ptr = rng.integers(0, 6, 40), rng.normal(size=40), np.arange(0, 41, 4)
    y, w, t = rng.integers(0, 3, 10), rng.normal(size=6), np.array([-0.5, 0.7])
    value, gw, gt = ordinal._gradient(idx, val, ptr, y, w, t)
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert abs((ordinal._gradient(idx, val, ptr, y, w + e, t)[0] - value) / 1e-6 - gw[i]) < 1e-3
    for i in range(2):
        e = np.eye(2)[i] * 1e-6
        assert abs((ordinal._gradient(idx, val, ptr, y, w, t + e)[0] - value) / 1e-6 - gt[i]) < 1e-3


def corpus(n=400):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(["the", "of", "sea", "hill", "road", "tree", "wind"]) for _ in range(rnd.randrange(20, 60))]
        quality, toxic = int(rnd.random() > 0.3), int(rnd.random() < 0.3)
        if not quality:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["blurg", "snark"])
        rows.append((i, " ".join(words), quality))
        labels.append((i, quality, toxic))
    return rows, labels


def test_held_out_accuracy_and_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, " ", 1)], "doc_id long, text string, p_top int").repartition(3)
    rated = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs, rated.filter("doc_id % 2 = 0 or doc_id is null"), ordinal.passed(), steps=30)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["row"]["doc_id"]: r for r in ordinal.grade_documents(docs, model).collect()}
    assert len(got) == 402 and got[900]["expected_grade"] == got[901]["expected_grade"]
    right = [got[i]["selected"] == (q == 1 and t == 0) for i, q, t in labels if i % 2]
    assert np.mean(right) > 0.93
    mean = [np.mean([got[i]["expected_grade"] for i, q, t in labels if i % 2 and q + 1 - t == g]) for g in range(3)]
    assert mean == sorted(mean)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs, labels, ordinal.passed())
    assert [r["selected"] for r in ordinal.grade_documents(docs, model).collect()] == [True]
    assert ordinal.grade_documents(docs.limit(0), model).count() == 0


def test_scores_equal_blocks(spark):
    """Blocks for learning and scores for prediction hold the same features."""
    rows, _ = corpus(30)
    df = spark.createDataFrame([(t, 0) for _, t, _ in rows], "text string, grade int").coalesce(1)
    block = ordinal._blocks(df).first()
    w = np.random.default_rng(0).normal(size=ordinal.DIM).astype(np.float32)
    idx, val, ptr = np.frombuffer(block["idx"], np.int32), np.frombuffer(block["val"], np.float32), np.frombuffer(block["ptr"], np.int64)
    want = np.bincount(np.repeat(np.arange(30), np.diff(ptr)), val * w[idx], 30)
    got = ordinal.Model(w, np.array([0.0, 1.0])).scores(pa.array([t for _, t, _ in rows]))
    assert np.allclose(want, got, atol=1e-3)
