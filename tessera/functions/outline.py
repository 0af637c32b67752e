"""Outlines of YAML and Markdown texts: each key or heading with its level, its parent and the way to it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "line int, level int, name string, parent_line int, way string"
_KEY = re.compile(r"""(\s*(?:-\s+)*)("[^"]*"|'[^']*'|[^\s#'"\[{&*!|>%@`-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?=\s|$)(.*)""")
_BLOCK = re.compile(r"\s*(?:[&!]\S+\s+)*[|>][-+0-9]*\s*(?:#.*)?$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")

Found = tuple[int, int, str, bool]


def yaml_keys(text: str) -> Iterator[Found]:
    """(line, indent, key, whether it begins a list item). Block scalars and comments hold no keys; a dash indents as a blank does."""
    block = None
    for n, line in enumerate(text.splitlines(), 1):
        indent = len(line) - len(line.lstrip())
        if block is not None and (not line.strip() or indent > block):
            continue
        block = None
        found = _KEY.match(line)
        if found:
            yield n, len(found[1]), found[2].strip("\"'"), "-" in found[1]
            if _BLOCK.match(found[3]):
                block = len(found[1])


def md_headings(text: str) -> Iterator[Found]:
    """(line, number of marks, heading, False), outside fenced code."""
    fence = None
    for n, line in enumerate(text.splitlines(), 1):
        mark = _FENCE.match(line)
        if fence is not None:
            if mark and mark[1].startswith(fence) and not line.strip(" `~"):
                fence = None
            continue
        if mark:
            fence = mark[1]
            continue
        found = _HEADING.match(line)
        if found:
            yield n, len(found[1]), found[2] or "", False


def nested(found: Iterator[Found], between: str) -> Iterator[tuple[int, int, str, int | None, str]]:
    """Rows of an outline: the parent is the nearest one before of a smaller indent, kept on a stack. Keys of a list's items
    go by `[]`, the later ones of an item as well as its first."""
    stack: list[tuple[int, int, str, bool]] = []
    for line, indent, name, item in found:
        while stack and stack[-1][0] > indent:
            stack.pop()
        if stack and stack[-1][0] == indent:
            item = stack.pop()[3] or item
        above = stack[-1] if stack else None
        way = (above[2] if above else "") + ("[]" if item else "")
        way = way + between + name if way else name
        yield line, len(stack) + 1, name, above[1] if above else None, way
        stack.append((indent, line, way, item))


def rows(files: DataFrame, kind: str, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, level, name, parent_line, way) of the keys of `yaml` or the headings of `markdown` files, of any depth; a null text
    has none. Files are read where they are; a file is one row's work, linear in its length."""
    of, between = {"yaml": (yaml_keys, "."), "markdown": (md_headings, " > ")}[kind]
    names = ["path", *(c.split()[0] for c in ROW.split(", "))]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, *r) for at, t in enumerate(batch.column("text").to_pylist()) for r in nested(of(t or ""), between)]
            at, *columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"path {files.schema[path].dataType.simpleString()}, {ROW}")
