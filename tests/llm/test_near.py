"""The near-duplicate stage's step over fingerprints, and what it writes."""

import random
from pathlib import Path

import numpy as np
from test_simhash import brute_kept, union

from tessera.llm import simhash
from tessera.sources import storage


def texts_of(rnd, n):
    return [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for _ in range(6)]


def test_fingerprints_give_the_first_pairs(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(4))) for b in base for _ in range(12)]
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(np.array(fps, np.uint64).view(np.int64).tolist())], "node_id long, fp long")
    met = [(r["a"], r["b"]) for r in simhash.met_fingerprints(nodes).collect()]
    n = len(fps)
    assert all(a < b and bin(fps[a] ^ fps[b]).count("1") <= 2 for a, b in met) and len(set(met)) == len(met)
    assert union(n, met) == union(n, [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])


def test_near_texts_go_by_fingerprints_first(spark, monkeypatch):
    """Copies with one new word in a thousand meet in the index, and are compared no second time; texts whose fingerprints are far apart are found too."""
    rnd = random.Random(6)
    texts = texts_of(rnd, 1000) + texts_of(rnd, 100)
    for t in list(texts):
        words = t.split()
        words[50:55] = ["new"] if len(words) > 500 else [f"n{i}" for i in range(5)]
        texts.append(" ".join(words))
    texts.append(" ".join([*texts[0].split()[:-1], "last"]))
    found, compared = [], []
    given, write = simhash.met_fingerprints, simhash.materialize

    def met(nodes):
        out = given(nodes)
        found.extend((r["a"], r["b"]) for r in out.collect())
        return out

    def seen(df, name, **more):
        out = write(df, name, **more)
        if name == "candidates":
            compared.append({(r["a"], r["b"]) for r in out.collect()})
        return out

    monkeypatch.setattr(simhash, "met_fingerprints", met)
    monkeypatch.setattr(simhash, "materialize", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.near_texts(docs).collect()} == brute_kept(texts) == set(range(12))
    assert found and compared[0] == set(found) and not compared[0] & set().union(*compared[1:]) and any(compared[1:])


def test_near_texts_write_rows_of_shared_shingles_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    rnd = random.Random(7)
    rows, write = {}, simhash.materialize

    def seen(df, name, **more):
        out = write(df, name, **more)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    texts = texts_of(rnd, 400) + ["word " + t for t in texts_of(rnd, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.near_texts(docs)
    assert kept.count() == len(texts)
    # Prefixes of some 80 shingles each; none stands in two texts. One table is left for the result to read.
    assert rows["shared"] == 0 and rows["prefixes"] == len(texts)
    assert [p.name[:14] for p in Path(tmp_path).iterdir()] == ["tessera-judged"]


def test_sketches_bound_the_difference_of_sets():
    rnd = np.random.default_rng(8)
    for n, m, both in ((0, 0, 0), (0, 3, 0), (1, 1, 1), (64, 65, 60), (100, 130, 90), (1000, 1100, 0), (1000, 1300, 950), (5000, 4100, 4000)):
        members = rnd.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        x, y = members[:n], members[n - both :]
        bound = simhash.surely_apart(simhash.parities(x), simhash.parities(y))
        assert bound == simhash.surely_apart(simhash.parities(y), simhash.parities(x)) <= n + m - 2 * both
        assert bound % 2 == (n + m) % 2
        assert both or not n or bound > (n + m) / 9
        assert simhash.surely_apart(simhash.parities(x), simhash.parities(x[::-1])) == 0


def test_near_texts_move_sets_of_likely_pairs_only(spark, monkeypatch):
    """Texts that share every other passage meet in the prefix filter, and aren't similar: their sets aren't written. Lists of two
    are settled by their hub."""
    rnd = random.Random(9)
    rows, open_rows = {}, []
    write, given = simhash.materialize, simhash.unsettled

    def seen(df, name, **more):
        out = write(df, name, **more)
        rows.setdefault(name, []).append(out.count())
        return out

    def unsettled(listed, found, node, key):
        out = given(listed, found, node, key)
        if key == ["k"]:
            open_rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    monkeypatch.setattr(simhash, "unsettled", unsettled)
    texts = []
    for a, b, c in zip(texts_of(rnd, 200), texts_of(rnd, 200), texts_of(rnd, 200), strict=True):
        texts += [f"{a} {b}", f"{a} {c}"]
    near = texts_of(rnd, 200)[0]
    texts += [near, near + " " + near.split()[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.near_texts(docs).collect()} == brute_kept(texts) == set(range(13))
    assert sum(rows["candidates"]) > 2 and sum(rows["sets"]) == 2
    assert open_rows == [0]
