"""Outlines of small texts."""

from tessera.functions import outline


def ways(of, text, between="."):
    return [(line, level, parent, way) for line, level, _, parent, way in outline.nested(of(text), between)]


def test_yaml_of_any_depth():
    deep = "\n".join(f"{' ' * i}k{i}:" for i in range(200))
    found = ways(outline.yaml_keys, deep)
    assert len(found) == 200 and found[-1][1:3] == (200, 199) and found[-1][3] == ".".join(f"k{i}" for i in range(200))
    assert ways(outline.yaml_keys, "- a: 1\n  b: 2\n- a: 3\n") == [(1, 1, None, "[].a"), (2, 1, None, "[].b"), (3, 1, None, "[].a")]
    assert ways(outline.yaml_keys, "x:\n- y: 1\n  z: 2\n-not: 3\n") == [(1, 1, None, "x"), (2, 2, 1, "x[].y"), (3, 2, 1, "x[].z"), (4, 1, None, "-not")]
    assert ways(outline.yaml_keys, "a: >-\n  b: text\nc: 'd: e'\n# f: g\n\"h i\": http://x\n") == [(1, 1, None, "a"), (3, 1, None, "c"), (5, 1, None, "h i")]


def test_markdown_sections():
    assert ways(outline.md_headings, "# A\n### B\n## C\n~~~\n# no\n~~~\n#no\n# \n", "/") == [(1, 1, None, "A"), (2, 2, 1, "A/B"), (3, 2, 1, "A/C"), (8, 1, None, "")]


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a: 1")], "path int, text string")
    assert [tuple(r) for r in outline.rows(rows, "yaml").collect()] == [(3, 1, 1, "a", None, "a")] and outline.rows(rows.limit(0), "markdown").count() == 0
