import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import rules

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in WS.split(text) if w]
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    hit, seen = set(), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def sample(n=150, seed=6):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "é", "a " * 8, "a " * 9, "a b " * 30, "x\x0b\x0cy\x1cz w", "l\nl\n\n \nl"]
    for _ in range(n):
        w = [rnd.choice(["ab", "Ü#", "c|", "dd", "e", "lorem"]) for _ in range(rnd.randrange(80))]
        if rnd.random() < 0.5:
            w += w[3:20]
        texts.append("".join(x + rnd.choice([" ", "\n", "  "]) for x in w))
    return texts


def test_statistics_against_brute_force(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in rules.STATS[:5]) for r in rules.statistics(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def rated(n=900):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        kind = rnd.choice(["good", "good", "good", "symbols", "shout"])
        words = [rnd.choice("abcdefghijklm") * rnd.randrange(1, 7) for _ in range(rnd.randrange(25, 120))]
        if kind == "symbols":
            words = [w + "#*" for w in words]
        if kind == "shout":
            words = [w.upper() + "!" for w in words]
        rows.append((i, " ".join(words), int(kind == "good")))
    return rows


def test_list_learned_on_half_decides_the_other(spark):
    rows = rated()
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = rules.statistics(docs)
    found = rules.learn(stats, docs.filter("doc_id % 2 = 0"), F.col("quality") == 0)
    assert 1 <= len(found.rules) <= rules.MAX_RULES and "reject if" in str(found)
    got = {r["doc_id"]: r["kept"] for r in rules.judged(stats, found).collect()}
    assert np.mean([got[i] == (q == 1) for i, _, q in rows if i % 2]) > 0.97


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (2, None), (3, " ".join(map(str, range(30))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = rules.learn(rules.statistics(docs), none, F.col("quality") == 0)
    assert found.rules == []
    assert {r["doc_id"]: r["kept"] for r in rules.judged(rules.statistics(docs), found).collect()} == {1: False, 2: False, 3: True}
    assert rules.statistics(docs.limit(0)).count() == 0
