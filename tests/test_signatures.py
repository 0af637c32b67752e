"""Signatures against a walk of Python's own tree; matches against their definition; dependency reports by hand."""

import ast
from difflib import SequenceMatcher

import pytest

from tessera.functions import python_source
from tessera.operators import graph, signatures

SOURCE = '''
class Store:
    @staticmethod
    @cached(size=3)
    @app.route("/x")
    def load_user(self, path, key=None) -> dict:
        """Loads the user of a path from the table."""
        with open(path) as f:
            for line in f:
                if line and key or not line:
                    yield parse(line) + self.parse(line) * 2
                elif line == key:
                    total = total % 7 - len(line) // 3
        def inner(x):
            while x < 3 < 4:
                x = step(x)
            return x
        try:
            return inner(total)
        except ValueError:
            pass

def saveUser(path): return write(path, open(path)) ** 2

def saveUser(path):
    return None

def empty(): pass
'''
MORE = '''
def load_users(path):
    """Loads users of the table."""
    with open(path) as f:
        for line in f:
            parse(line)

def x():
    return 1 - 2
'''
NAMES = {"Add": "add", "Sub": "sub", "Mult": "mult", "Div": "div", "Mod": "mod", "Pow": "pow"}
FLOW = {ast.If: "if", ast.For: "for", ast.While: "while", ast.Try: "try", ast.With: "with"}


def plain(text):
    """{(lineno, name): (calls, variables, flow, operations)} by a visit in the order of the tree."""
    out = {}
    for f in ast.walk(ast.parse(text)):
        if isinstance(f, ast.FunctionDef):
            calls, names, flow, ops = set(), set(), [], []

            def visit(n):
                if isinstance(n, ast.Call):
                    calls.add(getattr(n.func, "id", getattr(n.func, "attr", None)))
                elif isinstance(n, ast.Name):
                    names.add(n.id)
                elif type(n) in FLOW:
                    flow.append(FLOW[type(n)])
                elif isinstance(n, ast.BinOp):
                    ops.append(NAMES.get(type(n.op).__name__, "binop"))
                elif isinstance(n, ast.Compare):
                    ops.append("compare")
                elif isinstance(n, ast.BoolOp):
                    ops.append(type(n.op).__name__.lower())
                for c in ast.iter_child_nodes(n):
                    visit(c)

            for part in [f.args, *f.body, *([f.returns] if f.returns else [])]:
                visit(part)
            out[f.lineno, f.name] = (sorted(calls), sorted(names), flow, sorted(ops))
    return out


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", MORE), ("bad.py", "def ("), ("none.py", None), ("empty.py", "")], "path string, text string")
    return signatures.signatures(python_source.parse(files)).cache()


def test_signatures_equal_a_walk(found):
    rows = {(r.path, r.lineno, r.name): (r.calls, r.variables, r.flow, r.operations) for r in found.collect()}
    assert rows == {(p, *k): v for p, text in (("a.py", SOURCE), ("b.py", MORE)) for k, v in plain(text).items()}


def test_parts(found):
    r = found.filter("name = 'load_user'").first()
    assert (r.args, r.decorators, r.returns, r.words, r.parts) == (["path", "key"], ["staticmethod", "cached"], "dict", ["loads", "user", "path", "table"], ["load", "user"])
    assert found.filter("name = 'empty'").first().flow == []


def test_no_rows(spark, found):
    empty = spark.createDataFrame([], python_source.ENTITY)
    assert signatures.signatures(empty).count() == 0
    assert signatures.twins(empty.limit(0).transform(signatures.signatures)).count() == 0


def test_twins_share_arguments_calls_and_flow(found):
    """`empty` and `x` have none of them; operations aren't part of the digest."""
    assert [(r.n, r.files, tuple(r.first)) for r in signatures.twins(found).collect()] == [(2, 2, ("a.py", SOURCE.split("\n").index("def empty(): pass") + 1, "empty"))]


def test_matches_by_definition(found):
    from pyspark.sql import functions as F

    s = F.struct(*found.columns)
    pairs = found.select(s.alias("x")).crossJoin(found.select(s.alias("y")))  # ten functions
    like = lambda a, b, none: len(set(a) & set(b)) / len(set(a) | set(b)) if {*a, *b} else none
    got = signatures.matches(pairs, "x", "y").collect()
    assert len(got) == found.count() ** 2
    for r in got:
        x, y = r.x, r.y
        m, n = len(x.args), len(y.args)
        structure = [1.0 if m == n == 0 else 1 - abs(m - n) / max(m, n), like(x.decorators, y.decorators, 1.0)]
        if x.returns and y.returns:
            structure.append(1.0 if x.returns == y.returns else 0.5)
        flow = SequenceMatcher(None, x.flow, y.flow).ratio() if x.flow or y.flow else 1.0
        behaviour = [like(x.calls, y.calls, 1.0), flow, like(x.operations, y.operations, 1.0)]
        named = 1.0 if x.name == y.name else max(like(x.parts, y.parts, 0.5), SequenceMatcher(None, x.name.lower(), y.name.lower()).ratio())
        said = 0.5 if not x.words and not y.words else 0.3 if not x.words or not y.words else like(x.words, y.words, 0)
        want = [sum(structure) / len(structure), sum(behaviour) / 3, named, said]
        overall = sum(w * v for w, v in zip((0.3, 0.3, 0.25, 0.15), want, strict=True))
        assert [r.structural, r.behavioural, r.named, r.documented, r.overall] == pytest.approx([*want, overall], abs=6e-5)
        assert r.level == ("exact" if overall >= 0.95 else "similar" if overall >= 0.75 else "related" if overall >= 0.5 else "different")
        assert ("behaviour" in r.evidence) == (want[1] > 0.8)


def test_signatures_meet_in_one_shuffle(spark, found):
    """Functions and their bodies are grouped once, however many they are; bodies of one name stay apart."""
    rows = spark.createDataFrame([], python_source.ENTITY)
    plan = signatures.signatures(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    twice = found.filter("name = 'saveUser'").orderBy("lineno").collect()
    assert [r.calls for r in twice] == [["open", "write"], []] and [r.operations for r in twice] == [["pow"], []]


def test_repeated_pairs_are_matched_once(monkeypatch):
    import pandas as pd

    from tessera.operators import similarity

    made = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *a: made.append(a) or SequenceMatcher(*a))
    long = "ab" * 300  # difflib takes both letters for popular ones
    a, b = ["ifi", "ifi", "x", "", "", None, long, "fi"] * 5, ["fi", "fi", "x", "", "y", "z", long, "ifi"] * 5
    got = similarity.sequence_ratio.func(pd.Series(a), pd.Series(b)).tolist()
    assert [None if g != g else g for g in got] == [0.8, 0.8, 1.0, 1.0, 0.0, None, 1.0, 0.8] * 5
    assert len(made) == 2 and SequenceMatcher(None, long, long).ratio() == 1.0


def test_dependency_report(spark):
    rows = [("a", "os", None, "builtin"), ("a", "b", "b", "local"), ("a", "b.x", "b", "local"), ("a", "req", None, "third_party"), ("b", "a", "a", "local"), ("c", "c", "c", "local"), ("c", "b", "b", "local")]
    got = {r.src: tuple(r)[1:] for r in graph.dependency_report(spark.createDataFrame([*rows, ("e", "d", "d", "local")], "src string, module string, dst string, kind string")).collect()}
    assert got == {"a": (4, 2, 1, 1, 2, 0.325), "b": (1, 1, 0, 2, 1, 1.7), "c": (2, 2, 0, 1, 0, 0.65), "d": (0, 0, 0, 1, 0, 0.7), "e": (1, 1, 0, 0, 0, 0.3)}
    assert graph.dependency_report(spark.createDataFrame([], "src string, module string, dst string, kind string")).count() == 0
