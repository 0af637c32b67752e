"""Operators held against all pairs, or against Python's own walk of the same values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import json_text
from tessera.operators import code, cycles, diffs, impact
from tessera.operators.components import components

ENTITY = "kind string, path string, lineno int, name string, args array<string>, shape array<string>, details array<string>, docstring string"


def functions_of(seed, n):
    rnd = random.Random(seed)
    kinds = ["Assign", "Return", "If", "For", "With", "Raise", "Try", "Expr", "While"]
    words = "load save read write user file table row price tax".split()
    rows = []
    for i in range(n):
        shape = [rnd.choice(kinds) for _ in range(rnd.randrange(0, 7))]
        doc = None if rnd.random() < 0.4 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 5)))
        rows.append(("function", f"f{i % 7}.py", i, "_".join(rnd.sample(words, rnd.randrange(1, 3))) if rnd.random() < 0.8 else f"q{i}", ["a"] * rnd.randrange(6), shape, rnd.choice([None, [], ["cached"], ["cached", "static"]]), doc))
    return rows


def plain_groups(rows, threshold):
    """Components over all pairs, scored by the definition."""
    from tests_names import parts

    def like(x, y, none):
        x, y = set(x), set(y)
        return len(x & y) / len(x | y) if x | y else none

    def score(x, y):
        m, n = len(x[4]), len(y[4])
        structure = ((1.0 if max(m, n) == 0 else min(m, n) / max(m, n)) + like(x[6] or [], y[6] or [], 1.0)) / 2
        if x[7] is None and y[7] is None:
            doc = 0.5
        elif x[7] is None or y[7] is None:
            doc = 0.3
        else:
            doc = like(x[7].split(), y[7].split(), 0.0)
        return round(0.3 * structure + 0.3 * like(x[5], y[5], 0.0) + 0.25 * like(parts(x[3]), parts(y[3]), 0.0) + 0.15 * doc, 4)

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(rows):
        for j in range(i):
            if score(x, rows[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), set()).add(f"{r[1]}:{r[2]}:{r[3]}")
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.72, 0.9])
def test_semantic_groups_equal_all_pairs(spark, threshold):
    rows = functions_of(int(threshold * 100), 300)
    links = code.semantic_pairs(spark.createDataFrame(rows, ENTITY), threshold)
    got = {}
    for r in components(links.select("a", "b")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == plain_groups(rows, threshold)


def test_functions_of_one_set_of_statements_are_linked(spark):
    rows = [("function", "a.py", 1, "alpha", ["x", "y"], ["Assign", "Return"], [], None), ("function", "b.py", 1, "gamma", ["u", "v"], ["Assign", "Assign", "Return"], [], None)]
    assert [(r.a, r.b, r.score) for r in code.semantic_pairs(spark.createDataFrame(rows, ENTITY)).collect()] == [("a.py:1:alpha", "b.py:1:gamma", 0.675)]
    with pytest.raises(ValueError):
        code.semantic_pairs(spark.createDataFrame(rows, ENTITY), 0.4)


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}.{k}"
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for v in value:
            yield f"{path}[]"
            yield from walk(v, f"{path}[]")


def test_json_paths_of_any_depth(spark):
    deep = 1
    for k in range(12):
        deep = {f"k{k}": deep, "s": json.dumps({"not": [1]})} if k % 3 else [deep, '{"a": 1}', None]
    texts = ['{"a": "{\\"b\\": 1}"}', json.dumps(deep), "[1, [2, [3]]]", "{}", "[]", "7", '"{}"', "{broken", None, "", '{"a": {"b": {"c": {"d": {"e": 1, "f": null}}}}}']
    rows = list(enumerate(texts))
    want = set()
    for i, t in rows:
        try:
            want |= {(i, p) for p in walk(json.loads(t))} if t else set()
        except ValueError:
            pass
    got = json_text.paths(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_js_modules_with_dots_anywhere(spark):
    files = spark.createDataFrame([("src/app/util.ts",), ("src/y.js",), ("lib/core/index.js",)], "path string")
    imports = spark.createDataFrame([("src/app/main.js", m) for m in ("./a/../util", "@/x/../y", "../../lib/./core", ".././app//util", "../../../../lib/core", "react", "./gone")], "path string, module string")
    got = {r.module: (r.kind, r.resolved) for r in impact.resolve_js(imports, files).collect()}
    assert got == {
        "./a/../util": ("local", "src/app/util.ts"), "@/x/../y": ("local", "src/y.js"), "../../lib/./core": ("local", "lib/core/index.js"), ".././app//util": ("local", "src/app/util.ts"),
        "../../../../lib/core": ("local", "lib/core/index.js"), "react": ("third_party", None), "./gone": ("local", None),
    }
    assert spark.range(1).select(impact.folded(F.lit("a/../../b/./c"))).first()[0] == "b/c"


def plain_strong(edges):
    nodes = {x for e in edges for x in e}
    out = {x: set() for x in nodes}
    for a, b in edges:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), list(out[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += out[y]
        return seen

    far = {x: reach(x) for x in nodes}
    groups = {x: frozenset([x, *[y for y in far[x] if x in far[y]]]) for x in nodes}
    return {(x, min(g), len(g)) for x, g in groups.items() if len(g) > 1}


def test_strong_components(spark):
    rnd = random.Random(5)
    ring = [(i, i + 1) for i in range(1000, 1499)] + [(1499, 1000)]
    tail = [(i, i + 1) for i in range(2000, 2100)] + [(2100, 1000)]
    hub = [(5000, 5001 + i) for i in range(300)] + [(5001 + i, 5000) for i in range(0, 300, 3)]
    mesh = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)]
    pair = [(9000, 9001), (9001, 9000), (9001, 9002), (9002, 9003), (9003, 9001), (9003, 9003)]
    edges = ring + tail + hub + mesh + pair
    frame = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    assert {tuple(r) for r in cycles.strong_components(frame).collect()} == plain_strong(edges)
    assert cycles.strong_components(frame.filter("src < 0")).count() == 0


def test_colours_take_one_join_a_step(spark, monkeypatch):
    """Plans grow with the steps, and a write tells whether all is done: no step after the last one that raised a colour's node."""
    frame = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0)], "src long, dst long")
    step = frame.selectExpr("src", "dst", "cast(null as long) AS within")
    write, joins = cycles.materialize, []

    def counted(df, name, **more):
        if name == "colours":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name, **more)

    monkeypatch.setattr(cycles, "materialize", counted)
    got = {tuple(r) for r in cycles._spread(frame.selectExpr("src AS v", "src AS c"), step).collect()}
    assert got == {(i, 40) for i in range(41)}
    assert set(joins) == {cycles.HOPS} and len(joins) <= 41 // cycles.HOPS + 1


def applied(a, hunks):
    out, at = [], 0
    for start, old, begin, new, lines in hunks:
        begin_at = start - bool(old)
        out += a[at:begin_at]
        assert len(out) == begin - bool(new) and [x[1:] for x in lines if x[0] != "+"] == a[begin_at : begin_at + old] and sum(x[0] != "-" for x in lines) == new
        out += [x[1:] for x in lines if x[0] != "-"]
        at = begin_at + old
    return out + a[at:]


def test_hunks_give_the_other_text(spark):
    rnd, rows = random.Random(8), []
    for i in range(250):
        a = [rnd.choice(["x", "y", "", f"line {rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 40))]
        b = list(a) if i % 5 else [rnd.choice("xyz") for _ in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(3)] = [rnd.choice(["new", "x", "y"]) for _ in range(rnd.randrange(3))]
        for context in (0, 1, 3):
            assert applied(a, diffs.hunks(a, b, context)) == b
        assert (a == b) == (not diffs.hunks(a, b))
        rows.append((i, "\n".join(a), "\n".join(b)))
    got = diffs.unified(spark.createDataFrame([*rows, (999, None, "one"), (1000, "", None)], "k int, a string, b string").repartition(3), "k", "a", "b")
    assert got.filter("key = 999").collect()[0][1:6] == (1, 0, 0, 1, 1) and got.filter("key = 1000").count() == 0
    assert got.withColumn("h", diffs.header()).filter("key = 999").first()["h"] == "@@ -0,0 +1 @@"
