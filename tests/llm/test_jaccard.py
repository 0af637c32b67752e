"""The Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow.parquet as pq
from test_simhash import union
from tests_data import DATA

from tessera.llm import jaccard, queries
from tessera.llm.words import space_words


def brute(rows, size=4, percent=85):
    """Components by all pairs, a word's shingles as tuples."""
    sets = []
    for _, text in rows:
        w = space_words(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((j, i))
    roots = union(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, doc), doc)
    return sorted((doc, len(s), least[r]) for (doc, _), s, r in zip(rows, sets, roots, strict=True))


def changed(rnd, words, share):
    out = list(words)
    for i in range(len(out)):
        if rnd.random() < share:
            out[i] = rnd.choice([f"n{rnd.randrange(10**6)}", out[i] + "x", ""])
    return [w for w in out if w]


def corpus(seed, lengths, copies, words=400):
    rnd, texts = random.Random(seed), [None, "", " \n\t", "one", "ONE", "one two", "a b c d", "a b c e", "A b  c d"]
    passage = [f"p{i}" for i in range(60)]
    for n in lengths:
        base = [f"w{int(words * rnd.random() ** 3)}" for _ in range(n)]
        if rnd.random() < 0.3:
            base[rnd.randrange(n) : 0] = passage
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(copies)):
            texts.append(" ".join(changed(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))))
    rnd.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_all_pairs(spark):
    rnd = random.Random(1)
    rows = corpus(2, [rnd.choice([5, 8, 11, 14, 20, 33, 60, 120, 300, 900]) for _ in range(170)], 5)
    assert found(jaccard.jaccard_join(frame(spark, rows).repartition(5))) == brute(rows)


def test_equals_all_pairs_on_documents(spark):
    t = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    assert found(jaccard.jaccard_join(frame(spark, rows))) == brute(rows)


def test_group_of_near_copies_whose_members_are_not_all_linked(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(changed(rnd, base, 0.022))) for i in range(400)]
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < 400 and found(jaccard.jaccard_join(frame(spark, rows))) == want


def test_other_sizes_and_bounds(spark):
    rows = corpus(5, [3, 6, 9, 25, 70] * 8, 4)
    for size, percent in ((1, 60), (3, 100)):
        assert found(jaccard.jaccard_join(frame(spark, rows), size, percent)) == brute(rows, size, percent)


def test_similar_sets_meet_whatever_the_costs():
    rng = np.random.default_rng(3)
    for trial in range(1500):
        n = int(rng.integers(1, 250))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 6 + 1))
        y = np.concatenate([x[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        costs = rng.integers(0, 50, jaccard.BUCKETS).astype(float) if trial % 2 else np.full(jaccard.BUCKETS, 9.0)
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
            met = len(np.intersect1d(jaccard.lists_of(x, 85, costs), jaccard.lists_of(y, 85, costs)))
            assert met >= max(1, jaccard.fewest_lists(max(len(x), len(y)), 85) - 15 * (len(x) + len(y)) // 185)


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(7)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        assert jaccard.differences(jaccard.sketch(x), jaccard.sketch(y)) <= apart
    far = [jaccard.sketch(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1000, 1100)]
    assert jaccard.differences(*far) > 0.17 * 2100 / 1.85


def test_empty_segments_are_left_out():
    b = jaccard.band(jaccard.bands(1000, 85)[0], 85)
    whole, without = np.ones(b.segments), np.zeros(b.segments)
    whole[7] = 1e6
    assert b.segments + b.deletions > 2 * b.spare and jaccard.steps_left(whole, without, b)[7] == -1
    assert all(jaccard.band_start(k + 1, 85) > jaccard.band_start(k, 85) for k in range(60))


def test_cases(spark):
    kind = "doc_id long, text string, component_id string, n int"
    assert jaccard.jaccard_join(spark.createDataFrame([], kind)).count() == 0
    long_text = " ".join(f"t{i % 7919}x{i % 31}" for i in range(150_000))
    rows = [(4, long_text, "c", 1), (2, long_text + " end", "c", 1), (9, "a b c", None, 2), (9, "a b c", None, 2), (None, "a b c", None, 2), (None, "alone here", None, 2), (None, None, None, 3), (7, "", None, 3)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, kind)).collect()
    by = sorted(((r.doc_id, r.n_shingles > 1, r.component_id) for r in got), key=str)
    alone = [(None, False, None), (None, False, None), (7, False, 7)]
    assert by == sorted([(4, True, 2), (2, True, 2), (9, False, 9), (9, False, 9), (None, False, 9), *alone], key=str)
    assert queries.QUERIES["op12_jaccard"]


def test_parities_rule_out_no_similar_pair(spark):
    """Fewer bins differ than elements do, at every size; the condition keeps every pair of 85 % and drops most unlike ones."""
    rng = np.random.default_rng(5)
    rows, similar = [], []
    for i in range(300):
        n = int(rng.choice([1, 2, 7, 30, 100, 300, 900, 4000]))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.1, 0.85, 0.93, 0.99, 1.0])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 12)), np.uint64)]))
        p, q = jaccard.parities(a), jaccard.parities(b)
        assert int(np.bitwise_count((p ^ q).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
        both = len(np.intersect1d(a, b))
        similar.append(100 * both >= 85 * (len(a) + len(b) - both) and both > 0)
        rows.append((i, len(a), *map(int, p), len(b), *map(int, q)))
    sides = [", ".join(f"{s}{c} long" for c in ("n", *jaccard.FOLDS)) for s in "xy"]
    df = spark.createDataFrame(rows, f"i long, {sides[0]}, {sides[1]}")
    both = df.selectExpr("i", *[f"named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {s}{c}' for c in ('n', *jaccard.FOLDS))}) AS {s}" for s in "xy"])
    kept = {r.i for r in both.filter(jaccard.may_be_similar("x", "y", 85)).select("i").collect()}
    assert {i for i, s in enumerate(similar) if s} <= kept
    assert sum(similar) > 30 and len(kept) < 300 - 30
