"""Three-way merges against edits whose result is known; checks of sources."""

import random

from tessera.operators import merging


def text_of(regions):
    out = []
    for kind, _, _, ours, theirs in regions:
        out += [merging.MARKS[0], *ours, merging.MARKS[1], *theirs, merging.MARKS[2]] if kind == "conflict" else theirs if kind == "theirs" else ours
    return out


def edited(rnd, base, spans, mark):
    """`base` with the spans replaced by none to three new lines."""
    out, at, new = [], 0, {}
    for s, e in spans:
        new[s] = [f"{mark}{s}.{i}" for i in range(rnd.randrange(4))]
        out += base[at:s] + new[s]
        at = e
    return out + base[at:], new


def test_disjoint_edits_give_the_known_text():
    rnd = random.Random(4)
    for _ in range(300):
        base = [f"line {i}" for i in range(rnd.randrange(4, 60))]
        cuts = sorted(rnd.sample(range(len(base) + 1), rnd.randrange(2, min(12, len(base)))))
        spans = [(s, max(s + 1, e - 1)) for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1]
        mine = [s for s in spans if rnd.random() < 0.5]
        yours = [s for s in spans if s not in mine]
        a, na = edited(rnd, base, mine, "a")
        b, nb = edited(rnd, base, yours, "b")
        want, at = [], 0
        for s, e in spans:
            want += base[at:s] + (na | nb)[s]
            at = e
        found = merging.regions(base, a, b)
        assert text_of(found) == want + base[at:] and not [r for r in found if r[0] == "conflict"]


def test_one_side_or_equal_sides_win_for_any_text():
    rnd = random.Random(9)
    for _ in range(400):
        x, y, z = (["".join(rnd.choice("ab") for _ in range(1)) for _ in range(rnd.randrange(9))] for _ in range(3))
        assert text_of(merging.regions(x, y, x)) == y and text_of(merging.regions(x, x, y)) == y and text_of(merging.regions(x, y, y)) == y
        found = merging.regions(x, y, z)
        assert sum(r[2] for r in found) == len(x) and [r[1] for r in found] == [sum(q[2] for q in found[:i]) for i in range(len(found))]
        assert [s for r in found for s in r[3]] == y or any(r[0] == "theirs" for r in found)


def test_conflicts_are_named(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nX\nc", "a\nY\nc"), (2, None, "", None), (3, "", "new", "new"), (4, "a\nb\nc", "a\nc", "a\nb\nc\nd"), (5, "a", None, "b")], "key int, base string, ours string, theirs string")
    found = merging.three_way(rows, "key", "base", "ours", "theirs")
    assert [(r.region, r.kind, r.base_start, r.base_lines) for r in found.filter("key = 1").orderBy("region").collect()] == [(1, "same", 0, 1), (2, "conflict", 1, 1), (3, "same", 2, 1)]
    texts = {r.key: (r.text, r.n_conflicts, r.n_changes) for r in merging.merged(found).collect()}
    assert texts == {
        1: ("a\n<<<<<<< ours\nX\n=======\nY\n>>>>>>> theirs\nc", 1, 1), 3: ("new", 0, 1), 4: ("a\nc\nd", 0, 2), 5: ("<<<<<<< ours\n=======\nb\n>>>>>>> theirs", 1, 1),
    }
    assert merging.merged(merging.three_way(rows.limit(0), "key", "base", "ours", "theirs")).count() == 0


def test_checks(spark):
    files = [("a", "import os\nimport os\nimport os, re\nfrom . import x\nfrom .re import y\n"), ("b", "def f(:\n"), ("c", None), ("d", "<<<<<<< ours\n")]
    found = {r.path: r for r in merging.checks(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found["a"].duplicates == ["os", "os", "re"] and found["a"].n_imports == 5 and not found["a"].success and found["a"].syntax_valid
    assert not found["b"].syntax_valid and not found["d"].syntax_valid and found["b"].error_line == 1 and found["c"].success
