"""Parsing in many tasks, of what is asked for only, and of trees of any depth; copies of functions as one node."""

from tessera.functions import python_source
from tessera.operators import code
from tessera.operators.components import components

SOURCE = '''
class Store:
    def load(self, path, key=None):
        """Loads."""
        for line in open(path):
            if line and key:
                def inner(x):
                    while x < 3 < 4 < 5:
                        x = x + "a"
                    return type(x)
        return inner
limit = 7
'''


def test_one_split_is_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(f"f{i}.py", SOURCE) for i in range(400)], "path string, text string").coalesce(1)
    sizes = python_source.parse(files).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) <= sum(sizes) / 4


def test_columns_and_kinds_are_cuts_of_all_rows(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    every = python_source.parse(files).collect()
    for columns, kinds in [*code.READS.values(), (("nesting", "kind"), ("function", "defaults")), (None, ("class", "error")), (("path",), ("read", "call"))]:
        got = python_source.parse(files, columns=columns, kinds=kinds)
        assert got.columns == [c for c in python_source.COLUMNS if columns is None or c in columns]
        want = [tuple(r[c] for c in got.columns) for r in every if kinds is None or r["kind"] in kinds]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want


def test_deep_trees(spark):
    files = spark.createDataFrame([("sum.py", "x = " + " + ".join(["a"] * 3000))], "path string, text string")
    assert python_source.parse(files).filter("kind = 'operation'").count() == 2999


def test_copies_of_functions_make_no_pairs(spark):
    """Links grow with the functions: one of each copy, none between copies."""
    rows = [("function", f"f{i}.py", 1, f"price_{'ab'[i % 2]}", ["x"], ["Assign", "If", "Return"], [], "Size 3.") for i in range(200)]
    links = code.semantic_pairs(spark.createDataFrame(rows, "kind string, path string, lineno int, name string, args array<string>, shape array<string>, details array<string>, docstring string")).collect()
    assert len(links) == len({(r.a, r.b) for r in links}) == 199
    found = components(spark.createDataFrame([(r.a, r.b) for r in links], "a string, b string"))
    assert found.count() == 200 and found.select("component").distinct().count() == 1


def test_copies_below_the_threshold_meet_through_others(spark):
    """Functions without statements score 0.625 with their copies; those told without words 0.85, and 0.895 with an untold one."""
    schema = "kind string, path string, lineno int, name string, args array<string>, shape array<string>, details array<string>, docstring string"
    frame = spark.createDataFrame([("function", f"{p}.py", 1, n, [], [], [], None) for p, n in (("a", "load_x"), ("b", "load_x"), ("c", "save_y"))], schema)
    assert {(r.a, r.b, r.score) for r in code.semantic_pairs(frame, 0.6).collect()} == {("a.py:1:load_x", "b.py:1:load_x", 0.625)}
    assert code.semantic_pairs(frame, 0.63).count() == 0
    told = spark.createDataFrame([("function", f"{p}.py", 1, "load_x", ["k"], ["If", "Return"], [], d) for p, d in (("a", ""), ("b", ""), ("c", None))], schema)
    links = {(r.a, r.b, r.score) for r in code.semantic_pairs(told, 0.87).collect()}
    assert links == {("a.py:1:load_x", "c.py:1:load_x", 0.895), ("b.py:1:load_x", "c.py:1:load_x", 0.895)}


def test_counts_are_made_where_files_are_parsed(spark):
    """One row per file and kind leaves the parsing tasks; figures of files are those of all rows, a path given twice included."""
    files = spark.createDataFrame([("a.py", SOURCE), ("a.py", "import os"), ("b.py", "def ("), ("c.py", None), ("d.py", "x = y")], "path string, text string")
    counted = python_source.counted(files, kinds=code.READS["file_metrics"][1])
    every = python_source.parse(files)
    want = every.filter("kind in ('function', 'class', 'import', 'read', 'write', 'error')").groupBy("path", "kind").count()
    assert {tuple(r) for r in counted.groupBy("path", "kind").agg({"n": "sum"}).collect()} == {tuple(r) for r in want.collect()}
    assert counted.filter("path = 'a.py'").count() == 5 < every.filter("path = 'a.py'").count()
    assert sorted(map(tuple, code.file_metrics(counted).collect())) == sorted(map(tuple, code.file_metrics(every).collect()))
