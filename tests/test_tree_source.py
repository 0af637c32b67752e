"""The file tree source against a plain walk; members of archives against the archives."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import tree_source


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for i in range(6):
        for j in range(3):
            d = top / f"p{i}" / f"q{j}"
            d.mkdir(parents=True)
            (d / f"m{j}.py").write_text("x" * (10 * i + j))
            (d / "data.BIN").write_bytes(b"1234")
    for skipped in ("p0/.git", "p1/q1/node_modules/deep"):
        (top / skipped).mkdir(parents=True)
        (top / skipped / "no.py").write_text("no")
    (top / "empty").mkdir()
    (top / "read me.md").write_text("")
    (top / "loop").symlink_to(top)
    return top


def walked(root):
    out = set()
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if f not in (".git", "node_modules")]
        out |= {(os.path.join(folder, f), os.path.getsize(os.path.join(folder, f))) for f in files}
    return out


@pytest.mark.parametrize("parts", [1, 2, 5, 64])
def test_equals_a_walk(spark, root, parts):
    rows = tree_source.tree(spark, str(root), parts).collect()
    assert sorted((r.path, r.length) for r in rows) == sorted(walked(root))
    assert {r.extension for r in rows} == {".py", ".bin", ".md"} and all(r.error is None and r.path == f"{r.folder}/{r.name}" for r in rows)


def test_folders_are_planned_as_many_tasks(spark, root):
    reader = tree_source.TreeReader({"path": str(root), "parts": "10"})
    pieces = reader.partitions()
    assert len(pieces) >= 10 and len({p.folder for p in pieces}) == len(pieces)
    assert tree_source.tree(spark, str(root), 10).rdd.getNumPartitions() == len(pieces)


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters(spark, root, pushed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        got = tree_source.tree(spark, str(root)).filter((F.col("length") > 20) & (F.col("extension") == ".py") & F.col("name").startswith("m")).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {(r.path, r.length) for r in got} == {(p, n) for p, n in walked(root) if n > 20 and p.endswith(".py")}


def test_missing_and_remote(spark, root):
    assert [(r.name, r.error) for r in tree_source.tree(spark, str(root / "gone")).collect()] == [("gone", "FileNotFoundError")]
    assert tree_source.tree(spark, str(root / "empty")).count() == 0
    with pytest.raises(ValueError):
        tree_source.TreeReader({"path": "s3://bucket/x"})


def test_members_of_one_archive_meet_in_many_ranges(spark, tmp_path):
    want = {}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("folder/", "")
        for i in range(40):
            want[f"folder/{i}.txt"] = bytes([65 + i % 26]) * (50 + i)
            z.writestr(f"folder/{i}.txt", want[f"folder/{i}.txt"])
    (tmp_path / "bad.zip").write_text("no archive")
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    listed = tree_source.tree(spark, str(tmp_path)).filter("extension = '.zip'").select("path", "length")
    rows = tree_source.zip_members(listed, max_bytes=85, span=500).collect()
    of_a = [r for r in rows if r.path.endswith("a.zip")]
    assert len(of_a) == 40 and {r.member: r.length for r in of_a} == {k: len(v) for k, v in want.items()}
    assert {r.member: bytes(r.content) for r in of_a if r.error is None} == {k: v for k, v in want.items() if len(v) <= 85}
    assert {r.error for r in of_a} == {None, "too_large"}
    assert [(os.path.basename(r.path), r.member, r.error) for r in rows if r not in of_a] == [("bad.zip", None, "BadZipFile")]
