"""Unified diffs of pairs of texts, as rows of hunks."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "hunk int, old_start int, old_lines int, new_start int, new_lines int, lines array<string>"


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Lines that stand once on both sides, the longest run of them that ascends on both."""
    ca, cb = Counter(a), Counter(b)
    there = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, there[x]) for i, x in enumerate(a) if ca[x] == 1 and x in there]
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _shortest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Equal lines of a shortest edit script, by furthest reaching paths on diagonals."""
    n, m, reach, trace = len(a), len(b), {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _walked(trace, n, m)
    return []


def _walked(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else k - 1
        px = reach[before] if d else 0
        py = px - before if d else 0
        while x > px and y > py:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = px, py
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal lines, ascending on both sides: common ends, then anchors, then a shortest script between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        found = _anchors(a[i:p], b[j:q])
        if not found:
            out += [(x + i, y + j) for x, y in _shortest(a[i:p], b[j:q])]
            continue
        cuts = [(i, j), *[(x + i + 1, y + j + 1) for x, y in found]]
        ends = [*[(x + i, y + j) for x, y in found], (p, q)]
        out += [(x + i, y + j) for x, y in found]
        todo += [(s, e, t, f) for (s, t), (e, f) in zip(cuts, ends, strict=True)]
    return sorted(out)


def hunks(a: list[str], b: list[str], context: int = 3) -> list[tuple[int, int, int, int, list[str]]]:
    """(old start, old lines, new start, new lines, lines) of each hunk; lines start with a blank, `-` or `+`. A side
    without lines names the line before."""
    edits, x, y = [], 0, 0
    for i, j in [*matches(a, b), (len(a), len(b))]:
        if i > x or j > y:
            edits.append((x, i, y, j))
        x, y = i + 1, j + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for e in edits:
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for g in groups:
        lead, tail = min(context, g[0][0]), min(context, len(a) - g[-1][1])
        start, begin, lines, at = g[0][0] - lead, g[0][2] - lead, [], g[0][0] - lead
        for i, p, j, q in g:
            lines += [" " + s for s in a[at:i]] + ["-" + s for s in a[i:p]] + ["+" + s for s in b[j:q]]
            at = p
        lines += [" " + s for s in a[at : at + tail]]
        old, new = at + tail - start, g[-1][3] + tail - begin
        out.append((start + bool(old), old, begin + bool(new), new, lines))
    return out


def unified(pairs: DataFrame, key: str, a: str, b: str, context: int = 3) -> DataFrame:
    """(key, hunk, old_start, old_lines, new_start, new_lines, lines): the hunks of each pair of texts, numbered from 1.

    Texts are split at line feeds; null is a text without lines; equal texts have no hunks. A pair is one row's work: lines unique on
    both sides anchor it, and only what lies between two anchors is searched for a shortest script, whose memory grows with the
    square of its edits."""
    kind = pairs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda t: [] if t is None or t == "" else t.split("\n")
        for batch in batches:
            keys, rows = [], []
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                for n, h in enumerate(hunks(split(x), split(y), context), 1):
                    keys.append(i)
                    rows.append((n, *h))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32()] * 5 + [pa.list_(pa.string())]
            names = ["key", "hunk", "old_start", "old_lines", "new_start", "new_lines", "lines"]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return pairs.select(F.col(key).alias("key"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).mapInArrow(work, f"key {kind}, {HUNK}")


def header(old_start: str = "old_start", old_lines: str = "old_lines", new_start: str = "new_start", new_lines: str = "new_lines"):
    """`@@ -start,lines +start,lines @@`; a single line leaves the number out."""
    side = lambda s, n: F.when(F.col(n) == 1, F.col(s).cast("string")).otherwise(F.concat_ws(",", s, n))
    return F.concat(F.lit("@@ -"), side(old_start, old_lines), F.lit(" +"), side(new_start, new_lines), F.lit(" @@"))
