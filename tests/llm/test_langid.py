import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "eit", "ver", "lo"], "cc": ["eau", "ion", "çe", "mi", "re"]}


def sample(n=240, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(4, 50))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_held_out_accuracy_and_cases(spark):
    rows = sample()
    extra = [(900, None, "aa"), (901, "123 !!", None), (902, "", "bb"), (903, rows[0][1], None), (904, rows[0][1], "aa")]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, score string").repartition(3)
    scorer = langid.fit(docs.filter("doc_id % 4 <> 2"), lang="score")
    got = {r["row"]["doc_id"]: r for r in langid.predict(docs, scorer).collect()}
    held = [(got[i]["lang_pred"] == x, got[i]["score"]) for i, _, x in rows if i % 4 == 2]
    assert np.mean([a for a, _ in held]) > 0.97 and all(0 <= s <= 1 for _, s in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == got[904]["lang_pred"] == got[0]["lang_pred"]
    assert np.mean([s for a, s in held if a]) > 0.5


def test_model_against_dictionaries(spark):
    """Interpolated Kneser-Ney from plain dictionaries gives the same bits."""
    words = Counter(w for _, t, _ in sample(30) for w in t.lower().split())
    order = 3
    grams = Counter()
    pad = lambda w: langid.START * (order - 1) + w + langid.END
    for w, n in words.items():
        for j in range(len(pad(w)) - order + 1):
            grams[pad(w)[j : j + order]] += n
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(h, c):
        low = p(h[1:], c) if h else 1 / (len({g[-1] for g in grams}) + 1)
        level = levels[len(h) + 1]
        own = {g: n for g, n in level.items() if g[:-1] == h}
        if not own:
            return low
        n1, n2 = (sum(n == x for n in level.values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return (max(own.get(h + c, 0) - d, 0) + d * len(own) * low) / sum(own.values())

    model = langid.Model(dict(grams), order)
    for w in [*list(words)[:20], "xyz", "kaé", "q"]:
        g, c, _ = langid._grams([w], order)
        want = [-math.log2(p(pad(w)[j : j + order - 1], pad(w)[j + order - 1])) for j in range(len(w) + 1)]
        assert model.bits(g, c).tolist() == pytest.approx(want)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    scorer = langid.fit(docs)
    assert [r["lang_pred"] for r in langid.predict(docs, scorer).collect()] == ["und"]
    assert langid.predict(docs.limit(0), scorer).count() == 0
    assert scorer.predict(pa.array([None], pa.string()))[0].to_pylist() == ["und"]
