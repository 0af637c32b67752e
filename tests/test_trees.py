"""Snapshot trees and rules on parsed files."""

import random
import re

from tessera.functions import python_source
from tessera.operators import code, trees
from tessera.sources.storage import new_dir

FILE = "path string, digest string, size long"


def test_changes_equal_a_full_comparison(spark):
    rnd = random.Random(2)
    old = {"/".join([*(rnd.choice("abc") for _ in range(rnd.randrange(5))), f"f{i}"]): str(rnd.randrange(9)) for i in range(400)} | {"empty/x": None}
    new = dict(old)
    for p in rnd.sample(sorted(old), 12):
        del new[p]
    for p in rnd.sample(sorted(new), 9):
        new[p] = "changed"
    new |= {"a/new": "1", "only/here/deep/y": "2", "top": None}
    stored = [trees.store(spark.createDataFrame([(p, v, 1) for p, v in t.items()], FILE), new_dir(spark, "tree")) for t in (old, new)]
    got = {(r.path, r.change) for r in trees.changes(*stored).collect()}
    want = {(p, "deleted") for p in old.keys() - new.keys()} | {(p, "created") for p in new.keys() - old.keys()} | {(p, "modified") for p in old.keys() & new.keys() if old[p] != new[p]}
    assert got == want
    assert trees.changes(stored[0], stored[0]).count() == 0 and trees.changed_folders(stored[1], stored[1]).count() == 0


def test_only_folders_that_differ_are_opened(spark):
    files = [(f"m{i % 40}/n{i % 7}/f{i}", str(i), 1) for i in range(1200)]
    old = trees.store(spark.createDataFrame(files, FILE), new_dir(spark, "tree"))
    new = trees.store(spark.createDataFrame([(p, "x" if p == "m3/n1/f43" else v, s) for p, v, s in files], FILE), new_dir(spark, "tree"))
    assert [(r.folder, r.own) for r in trees.changed_folders(old, new).orderBy("level").collect()] == [("", False), ("m3", False), ("m3/n1", True)]
    found = trees.changes(old, new)
    assert [(r.path, r.change) for r in found.collect()] == [("m3/n1/f43", "modified")]
    read = re.findall(r"PartitionFilters: \[([^]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    opened = [r for r in read if "shard" in r]
    assert opened and all(" = " in r for r in opened)


def test_empty_snapshots(spark):
    none = trees.store(spark.createDataFrame([(None, "1", 1)], FILE), new_dir(spark, "tree"))
    one = trees.store(spark.createDataFrame([("f", "1", 1)], FILE), new_dir(spark, "tree"))
    assert [tuple(r) for r in trees.changes(none, one).collect()] == [("f", "created")] and trees.changes(none, none).count() == 0


def test_rules_read_parsed_files(spark):
    text = "A_1 = 99\nbig = 99999999999999999999\nflag = True\nx = y = 12\nasync def f(a=1, b=2, c=3, d=4, *, e=5):\n    return 'a' + 'b' + a, type(b)\nclass C:\n    def type(self):\n        return self.type() + 1\n"
    rows = python_source.parse(spark.createDataFrame([("a.py", text), ("b.py", None)], "path string, text string"))
    got = sorted((r.rule, r.name, r.lineno, r.value) for r in code.smells(rows).collect())
    assert got == [("magic_number", "big", 2, 2**31 - 1), ("magic_number", "x", 4, 12), ("magic_number", "y", 4, 12), ("many_defaults", "f", 5, 4), ("string_sum", "", 6, 1), ("type_call", "", 6, 1)]
    assert {r.name for r in code.dead_variables(rows).collect()} == {"big", "flag", "x", "y"}
