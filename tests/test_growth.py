"""Operators whose cost grew faster than their rows, held against plain versions and against what they keep."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import compare, impact, search


def test_nearest_within_groups_equals_all_pairs(spark, monkeypatch):
    """Repeated vectors (ties by id), repeated ids, one without length, groups of one; blocks and tiles of any size."""
    rnd = random.Random(4)
    base = [[float(rnd.randrange(-2, 3)) for _ in range(3)] for _ in range(12)] + [[0.0] * 3]
    rows = [(rnd.randrange(110), rnd.choice("abc") if i else "alone", rnd.choice(base)) for i in range(150)] + [(500, None, base[0]), (501, "a", None)]
    frame = spark.createDataFrame(rows, "id long, g string, e array<double>")
    given = [(i, g, e) for i, g, e in {r[0]: r for r in rows if r[0] % 5 == 0}.values()]
    queries = spark.createDataFrame(given, "q long, g string, e array<double>")

    def plain(by):
        out = []
        for q, g, e in given:
            near = []
            for i, h, v in rows:
                if i != q and e and v and (not by or g is not None and g == h):
                    size = np.linalg.norm(e) * np.linalg.norm(v)
                    near.append((-(round(float(np.dot(e, v) / size), 6) if size else 0.0), i))
            out += [(q, r, i, -c) for r, (c, i) in enumerate(sorted(near)[:4], 1)]
        return sorted(out)

    for tiles, block, by in ((512, 4096, None), (7, 9, None), (7, 9, "g"), (512, 4096, "g")):
        monkeypatch.setattr(search, "QUERIES", tiles)
        monkeypatch.setattr(search, "ROWS", tiles)
        got = search.nearest(frame, queries, 4, block, by).collect()
        assert sorted((r["q"], r["rank"], r["id"], r["cosine"] + 0.0) for r in got) == plain(by)


def test_best_columns_are_no_more_than_asked():
    """A row of equal values keeps k of them, the least ids first, not all."""
    ids, cos = search._first(np.arange(100), np.ones((3, 100)), 5)
    assert ids.tolist() == [[0, 1, 2, 3, 4]] * 3 and cos.shape == (3, 5)


def test_function_kinds_unfold_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(compare, "MEMBERS", 4)
    rnd = random.Random(2)
    side = lambda at: [(rnd.choice(["f", "g", None]), at + i, rnd.choice(["h", "i"]), rnd.choice([["a"], ["a", "b"], []]), rnd.randrange(1, 3)) for i in range(90)]
    x, y = side(0), side(1000)
    frame = lambda rows: spark.createDataFrame(rows, "name string, path long, hash string, args array<string>, lines int")

    def score(p, q):
        if p[2] == q[2]:
            return 1.0
        a, b = set(p[3]), set(q[3])
        args = (1.0 if len(a) == len(b) else 0.5) if not a or not b else len(a & b) / len(a | b)
        return round((args + 1 - abs(p[4] - q[4]) / max(p[4], q[4])) / 2, 4)

    want = sorted((p[0], p[1], q[1], score(p, q)) for p in x for q in y if p[0] and p[0] == q[0] and score(p, q) >= 0.7)
    got = compare.function_matches(frame(x), frame(y), 0.7)
    assert sorted(map(tuple, got.collect())) == want and want
    assert got.rdd.getNumPartitions() > 4


def test_function_matches_writes_functions_and_no_pairs(spark, monkeypatch):
    """Unlike functions of few names, one of most functions, and of names that one side lacks: cells of a few functions give each pair once."""
    monkeypatch.setattr(compare, "MEMBERS", 3)
    monkeypatch.setattr(compare, "SIDE", 7, raising=False)
    written, write = [], compare.materialize

    def noted(df, *args, **kept):
        out = write(df, *args, **kept)
        written.append(out.count())
        return out

    monkeypatch.setattr(compare, "materialize", noted)
    rnd = random.Random(6)
    side = lambda at, only: [(rnd.choice(["f"] * 6 + ["g", "h", only]), at + i, f"h{rnd.randrange(40)}", ["a", "b", "c"][: rnd.randrange(4)], rnd.randrange(1, 50)) for i in range(120)]
    x, y = side(0, "x") + [("f", 400 + i, "same", ["a"], 5) for i in range(20)], side(1000, "y")
    frame = lambda rows: spark.createDataFrame(rows, "name string, path long, hash string, args array<string>, lines int")

    def score(p, q):
        if p[2] == q[2]:
            return 1.0
        a, b = set(p[3]), set(q[3])
        args = (1.0 if len(a) == len(b) else 0.5) if not a or not b else len(a & b) / len(a | b)
        return float(Decimal(repr((args + (1 - abs(p[4] - q[4]) / max(p[4], q[4]))) / 2)).quantize(Decimal("0.0001"), ROUND_HALF_UP))

    want = sorted((p[0], p[1], q[1], score(p, q)) for p in x for q in y if p[0] == q[0] and score(p, q) >= 0.3)
    assert sorted(map(tuple, compare.function_matches(frame(x), frame(y), 0.3).collect())) == want
    assert len(want) > 10 * len(x) and max(written) <= len(x)
    assert not compare.function_matches(frame(x), frame(y).filter("name = 'y'"), 0.3).collect()


def test_first_path_keeps_no_text_per_file(spark):
    """Files of one path stand in the index once; the least id of all paths that hold the module wins."""
    files = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "lib/a/m.py").otherwise("app/lib/a/m.py").alias("path")).filter("id > 0")
    found = impact.first_path_match(spark.createDataFrame([("x", "lib.a.m"), ("y", "a"), ("z", "b")], "path string, module string"), files)
    assert sorted(map(tuple, found.collect())) == [("x", "lib.a.m", "app/lib/a/m.py"), ("y", "a", "app/lib/a/m.py")]
    assert "SortAggregate" not in impact.first_path_match(files.select("path", F.lit("a").alias("module")), files)._jdf.queryExecution().executedPlan().toString()
