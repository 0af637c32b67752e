import io
import tarfile
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import markup, python_source
from tessera.functions import text as fn
from tessera.operators import code, dedup, evolution, graph, learn, search, similarity
from tessera.operators.components import components
from tessera.sources import files, sinks
from tessera.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, name, stem, ext, depth",
    [("/a/b/c.Py", "c.Py", "c", ".py", 4), ("x.tar.gz", "x.tar.gz", "x.tar", ".gz", 1), ("a/.env", ".env", ".env", "", 2), ("a/Makefile", "Makefile", "Makefile", "", 2)],
)
def test_paths(spark, path, name, stem, ext, depth):
    p = F.lit(path)
    assert one(spark, F.struct(fn.basename(p), fn.stem(p), fn.suffix(p), fn.depth(p))) == (name, stem, ext, depth)


def test_names_and_numbers(spark):
    assert one(spark, fn.split_name(F.lit("getHTTPResponse_code2"))) == ["get", "http", "response", "code", "2"]
    assert one(spark, F.struct(fn.snake_case(F.lit("fooBar")), fn.pascal_case(F.lit("foo_bar")))) == ("foo_bar", "FooBar")
    assert [one(spark, fn.affinity_level(F.lit(v))) for v in (1.0, 0.95, 0.7, 0.5, 0.31, 0.1)] == ["identical", "very_high", "high", "medium", "low", "minimal"]
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    assert one(spark, fn.jaccard(a, b)) == 0.5
    assert one(spark, fn.mean_of(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))) == 0.5
    assert one(spark, fn.occurrences(F.lit("if a: if b"), "if")) == 2


SOURCE = '''
import os, sys as system
from . import sibling
class Shape(Base):
    """Doc."""
    def area(self, k):
        if k and self:
            for i in range(3):
                while i:
                    i -= 1
        return k
async def fetch(url: str) -> int:
    try:
        x = url
    except:
        pass
    return x
'''


def test_python_entities(spark):
    rows = python_source.parse(spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken("), ("c.py", None)], "path string, text string")).collect()
    by = {(r["kind"], r["name"]): r for r in rows}
    assert by[("class", "Shape")]["args"] == ["Base"] and by[("class", "Shape")]["shape"] == ["area"] and by[("class", "Shape")]["docstring"] == "Doc."
    area = by[("function", "area")]
    assert (area["scope"], area["args"], area["complexity"], area["nesting"]) == ("Shape", ["self", "k"], 5, 3)
    assert by[("function", "fetch")]["is_async"] and by[("function", "fetch")]["returns"] == "int"
    assert by[("import", "sys")]["args"] == ["system"] and by[("import", ".")]["args"] == ["sibling"]
    assert [r["path"] for r in rows if r["kind"] == "error"] == ["b.py"] and ("bare_except", "") in by


def test_code_operators(spark):
    loop = "def {n}({a}):\n    total = 0\n    for {a}x in {a}:\n        total += {a}x * 2\n        total -= 1\n    return total\n"
    long = "def long_one(p, q, r, s, t, u):\n" + "    p = p + 1\n" * 60 + "    return p\n"
    texts = [("a.py", loop.format(n="f", a="m") + "\nf([])\n"), ("b.py", loop.format(n="f", a="m")), ("c.py", loop.format(n="g", a="k")), ("d.py", long), ("e.py", "class bad_name:\n    pass\n")]
    e = python_source.parse(spark.createDataFrame(texts, "path string, text string"))
    links = {(r["a"][0] + r["b"][0], r["type"]) for r in code.clones(code.fragments(e, min_tokens=10)).collect()}
    assert ("ab", "type1") in links and ("ac", "type2") in links
    groups = code.clone_groups(code.clones(code.fragments(e, min_tokens=10))).collect()
    assert [g["n_fragments"] for g in groups] == [3]
    dead = {(r["name"], r["confidence"]) for r in code.dead_code(e).collect()}
    assert ("g", 0.7) in dead and ("long_one", 0.7) in dead and not any(n == "f" for n, _ in dead)
    smells = {(r["rule"], r["name"]) for r in code.smells(e).collect()}
    assert {("long_function", "long_one"), ("many_parameters", "long_one"), ("naming", "bad_name")} <= smells
    flow = {r["variable"]: (r["first_write"], r["last_read"]) for r in code.data_flow(e).filter("path = 'b.py'").collect()}
    assert flow["total"] == (2, 6)


def test_markup(spark):
    md = "# One\n\n## Two ##\n[a](http://x)\n![i](y.png)\n- item\n> quote\n```py\nx\n```\n|a|b|\n"
    sql = "CREATE TABLE IF NOT EXISTS t (id INT, u INT REFERENCES v(id)); create unique index i on t(id); INSERT INTO t SELECT * FROM s JOIN r ON 1=1;"
    js = "import a from 'mod';\nexport class K {}\nasync function go(x) {}\nconst arrow = async (y) => y;\nlet z = 1;"
    frame = lambda t: spark.createDataFrame([("f", t)], "path string, text string")
    got = lambda t, lang: {(r["kind"], r["name"]) for r in markup.rows(frame(t), lang).collect()}
    assert got(md, "markdown") == {("heading", "One"), ("heading", "Two"), ("link", "http://x"), ("image", "y.png"), ("list_item", "item"), ("quote", "quote"), ("code_block", "py"), ("table_row", "a|b")}
    assert {("table", "t"), ("index", "i"), ("read", "s"), ("read", "r"), ("write", "t"), ("foreign_key", "v")} <= got(sql, "sql")
    assert {("import", "mod"), ("class", "K"), ("export", "K"), ("function", "go"), ("arrow", "arrow"), ("variable", "z")} <= got(js, "javascript")
    assert ("interface", "P") in got("interface P { a: string }", "typescript") and ("env", "HOME_DIR") in got("a: ${HOME_DIR}", "yaml")
    facts = markup.json_facts(spark.createDataFrame([("a", '{"x": [1]}'), ("b", "{bad")], "path string, text string")).collect()
    assert [(r["valid"], r["n_keys"]) for r in facts] == [(True, 1), (False, 0)]


def test_scan_archives_and_log(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"123")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.py").write_text("y")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/d.py", "z = 2")
        z.writestr("../evil.py", "no")
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        info = tarfile.TarInfo("e.py")
        info.size = 3
        t.addfile(info, io.BytesIO(b"e=1"))
    (tmp_path / "bad.zip").write_text("no archive")
    status = {r["name"]: r["status"] for r in files.scan(spark, str(tmp_path), [".py"]).collect()}
    assert status == {"a.py": "ok", "b.bin": "other_type", "c.py": "ignored", "z.zip": "archive", "t.tgz": "archive", "bad.zip": "archive"}
    inside = {(r["member"], r["error"]) for r in files.archive_members(spark, str(tmp_path), [".py"]).collect()}
    assert {("in/d.py", None), ("e.py", None), ("../evil.py", None)} <= inside and any(e for m, e in inside if m is None)
    (tmp_path / "log.txt").write_text("c1|Ann|2024-01-02T03:04:05+00:00|fix | this\nbad line\n")
    log = files.history_log(spark, str(tmp_path / "log.txt")).collect()
    assert [(r["author"], r["subject"]) for r in log] == [("Ann", "fix | this")]
    tops = {r["folder"]: r["n_files"] for r in files.folders(files.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert tops["src"] == 2 and tops["log.txt"] == 1


def test_affinity_and_pairs(spark):
    base = dict(functions=["f", "g"], classes=[], imports=["os"], variables=["x"], complexity=2.0, fingerprint="abcdefgh")
    rows = [Row(key=i, g="n", text=t, hash=h, **base) for i, (t, h) in enumerate([("hello world", "1"), ("hello world", "1"), ("hello there", "2")])]
    df = spark.createDataFrame(rows, "key int, g string, text string, hash string, functions array<string>, classes array<string>, imports array<string>, variables array<string>, complexity double, fingerprint string")
    got = {(r["x"]["key"], r["y"]["key"]): r for r in similarity.affinity(similarity.group_pairs(df, "g", "key")).collect()}
    assert got[(0, 1)]["overall"] == 1.0 and got[(0, 1)]["level"] == "identical"
    ratio = SequenceMatcher(None, "hello world", "hello there").ratio()
    assert got[(0, 2)]["overall"] == pytest.approx(0.4 * ratio + 0.6, abs=1e-4)
    assert similarity.group_pairs(df, "g", "key", cap=1).count() == 1


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (2, 1), (1, 2)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert {(r["node"], r["depth"]) for r in graph.reachable(edges, start).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert [r["node"] for r in graph.chain(edges, 1, 4).orderBy("pos").collect()] == [1, 2, 3, 4] and graph.chain(edges, 4, 1).count() == 0
    assert [tuple(r) for r in graph.two_cycles(edges).collect()] == [(1, 2)]
    assert {(r["node"], r["component"]) for r in components(edges, "src", "dst").collect()} == {(i, 1) for i in range(1, 6)}
    assert components(edges.limit(0), "src", "dst").count() == 0
    line = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a int, b int")
    assert {(r["node"], r["component"]) for r in components(line).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    imports = spark.createDataFrame([("app/m.py", "pkg"), ("app/m.py", "util"), ("app/m.py", "os.path"), ("app/m.py", "numpy")], "src string, module string")
    tree = spark.createDataFrame([("pkg/__init__.py",), ("app/util.py",)], "path string")
    got = {r["module"]: (r["kind"], r["dst"]) for r in graph.resolve_imports(imports, tree, builtin=["os"]).collect()}
    assert got == {"pkg": ("local", "pkg/__init__.py"), "util": ("local", "app/util.py"), "os.path": ("builtin", None), "numpy": ("third_party", None)}


def test_search_votes_and_fusion(spark):
    entries = spark.createDataFrame([(1, "parseFile", "reads a file"), (2, "write", "parse later"), (3, "reparse_all", "other")], "id int, name string, doc string")
    got = {r["id"]: r["score"] for r in search.score(search.build(entries, "id", "name", "doc"), ["parse"]).collect()}
    assert got == {1: 10.0, 2: 5.0, 3: 3.0}
    a = spark.createDataFrame([Row(x=Row(n=100.0, b=True, m=None), y=Row(n=85.0, b=False, m=1.0))], "x struct<n:double,b:boolean,m:double>, y struct<n:double,b:boolean,m:double>")
    assert a.select(learn.feature_similarity("x", "y", ["n", "m"], ["b"]).alias("s")).first()["s"] == 0.5
    parts = [("g", "function", "f", "def f(): 1", 1), ("g", "function", "f", "def f(): 2", 0), ("g", "function", "h", "def h(): 3", 1), ("g", "import", "os", "import os", 1)]
    fused = evolution.fuse(spark.createDataFrame(parts, "g string, kind string, name string, source string, rank int"), "g", "kind", "name", "source", "rank").first()
    assert fused["code"] == "import os\ndef f(): 2\ndef h(): 3"
    votes = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "b", 0.7, 3)], "q int, c string, s double, t int")
    assert learn.weighted_vote(votes, "q", "c", "s", "t").first()["c"] == "b"


def test_dedup_election(spark):
    rows = spark.createDataFrame([("n", 1, 5.0), ("n", 2, 10.0), ("n", 3, 10.0), ("m", 4, 0.0)], "g string, k int, s double")
    got = {r["g"]: (r["k"], r["confidence"]) for r in dedup.elect(rows, ["g"], F.col("s"), "k").filter("rank = 1").collect()}
    assert got == {"n": (2, 0.5), "m": (4, 0.5)}


def test_change_stream_equals_batch(spark, tmp_path):
    schema = "path string, hash string, ts timestamp"
    first = [("a", "1", "2024-01-01 00:00:00"), ("b", "1", "2024-01-01 00:00:01"), ("a", "1", "2024-01-01 00:00:02"), ("a", "2", "2024-01-01 00:00:03")]
    frame = spark.createDataFrame(first, "path string, hash string, t string").select("path", "hash", F.to_timestamp("t").alias("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = changes.change_feed(stream).writeStream.outputMode("append").format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["key"], r["change"]) for r in spark.table("feed").collect()) == [("a", "created"), ("a", "modified"), ("b", "created")]
    w = changes.windows(stream, "ts", "path", "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, changes.windows(frame, "ts", "path", "1 hour").collect()))
    hooks = spark.createDataFrame([("h1", True, ["x", "y"]), ("h2", False, ["x"])], "hook string, enabled boolean, kinds array<string>")
    assert [r["hook"] for r in changes.subscribed(spark.createDataFrame([("x",), ("z",)], "event_type string"), hooks).collect()] == ["h1"]


def test_snapshots(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = {(r["path"], r["change"]) for r in changes.snapshot_diff(s([("a", "1"), ("b", "1"), ("c", None)]), s([("a", "2"), ("c", None), ("d", "1")])).collect()}
    assert got == {("a", "modified"), ("b", "deleted"), ("d", "created")}


def test_reports(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r["value"] for r in sinks.graph_rows(edges, "dot").collect()] == ['  "a" -> "b";']
    assert "-->" in sinks.graph_rows(edges, "mermaid").first()["value"] and sinks.graph_rows(edges, "json").first()["value"] == '{"source":"a","target":"b"}'
    groups = spark.createDataFrame([("n", 0.5, ["x", "y"])], "name string, affinity double, paths array<string>")
    sinks.csv_report(groups, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"name": "n", "affinity": "0.5000", "paths": "x; y"}
    assert sinks.markdown_rows(groups, "name", ["affinity"]).first()["value"] == "## n\n- affinity: 0.5"
    assert sinks.json_lines(groups).first()["value"] == '{"name":"n","affinity":0.5,"paths":["x","y"]}'


def test_nearest_of_all_rows(spark):
    """Neighbours of other labels count; blocks of queries don't matter."""
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "id long, e array<double>").repartition(3)
    queries = rows.filter("id in (0, 2)").withColumnRenamed("id", "q")
    for block in (1, 100):
        got = sorted((r["q"], r["rank"], r["id"]) for r in search.nearest(rows, queries, 2, block).collect())
        assert got == [(0, 1, 3), (0, 2, 1), (2, 1, 1), (2, 2, 0)]
