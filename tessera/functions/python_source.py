"""Python source to entity rows. The grammar comes from the interpreter's own `ast`, which has no JVM
form; everything after the rows (metrics, rules, dead code, clones) is DataFrame work."""

from __future__ import annotations

import ast
import hashlib
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.joins import dealt

ENTITY = (
    "path string, kind string, name string, scope string, lineno int, end_lineno int, args array<string>, details array<string>, "
    "is_async boolean, docstring string, returns string, complexity int, nesting int, shape array<string>, source string, hash_exact string, hash_renamed string, renamed string"
)
COLUMNS = [c.split()[0] for c in ENTITY.split(", ")]
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While)
_FLOW = (ast.If, ast.For, ast.While, ast.Try, ast.With)
#: Operators with a name of their own.
_OPERATIONS = ("add", "sub", "mult", "div", "mod", "pow", "and", "or")
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITION = (*_FUNCTION, ast.ClassDef)
#: Columns that hold a definition's code; the columns that every row fills.
_CODE, _PLAIN = ("source", "hash_exact", "hash_renamed", "renamed"), ("path", "kind", "name", "scope", "lineno", "end_lineno", "args", "details")


class _Rename(ast.NodeTransformer):
    """Names and arguments by order of appearance, so that copies with other names are equal."""

    def __init__(self):
        self.names: dict[str, str] = {}

    def visit_Name(self, node: ast.Name) -> ast.AST:
        node.id = self.names.setdefault(node.id, f"v{len(self.names)}")
        return node

    def visit_arg(self, node: ast.arg) -> ast.AST:
        node.arg, node.annotation = self.names.setdefault(node.arg, f"v{len(self.names)}"), None
        return node


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def _renamed(source: str) -> str:
    try:
        tree = _Rename().visit(ast.parse(source))
        tree.body[0].name = "f"
        return ast.unparse(tree)
    except (SyntaxError, AttributeError, IndexError, RecursionError):
        return re.sub(r"\s+", "", re.sub(r"#[^\n]*", "", source))


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes, the last first, without constants and those that have no parts (contexts, operators, `pass`)."""
    out: list[ast.AST] = []
    for name in reversed(node._fields):
        part = getattr(node, name, None)
        if isinstance(part, list):
            out += [c for c in reversed(part) if isinstance(c, ast.AST) and c._fields and type(c) is not ast.Constant]
        elif isinstance(part, ast.AST) and part._fields and type(part) is not ast.Constant:
            out.append(part)
    return out


def entities(path: str, text: str | None, coded: bool = True, kinds: Collection[str] | None = None) -> list[tuple]:
    """Rows of one file, in order: the values of `_PLAIN` and those of other columns by name. They are functions, classes, imports, variables
    (writes), reads, calls, patterns of the rules (defaults of a function, whole numbers given to names, sums with a string, calls
    of `type`), branches and loops (flow), operations, or one error row; of `kinds` only, if given. Code columns are left out unless `coded`.

    One walk with a stack of its own serves all rows: trees of any depth are read, and a definition's complexity and nesting are
    differences of what the walk has counted, so that nested ones cost no further walk."""
    rows: list[tuple] = []
    wanted = lambda k: kinds is None or k in kinds
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "error", type(e).__name__, None, getattr(e, "lineno", None) or 0, None, None, None, {})] if wanted("error") else rows
    lines = (text or "").splitlines()

    def block(node: ast.AST) -> str:
        cut = lines[node.lineno - 1 : node.end_lineno]
        indent = len(cut[0]) - len(cut[0].lstrip()) if cut else 0
        return "\n".join(x[indent:] if not x[:indent].strip() else x for x in cut)

    def add(n: ast.AST, scope: str, kind: str, name: str, args: list[str] | None = None, details: list[str] | None = None, more: dict | None = None) -> None:
        if wanted(kind):
            rows.append((path, kind, name, scope, getattr(n, "lineno", None), getattr(n, "end_lineno", None), args, details, more))

    def define(n: ast.AST, scope: str) -> list[dict]:
        """Adds the rows of a definition; their complexity and nesting are filled in at its end."""
        kind = "class" if type(n) is ast.ClassDef else "function"
        given = [] if kind == "class" or not wanted("defaults") else [ast.unparse(v) for v in n.args.defaults]
        if not given and not wanted(kind):
            return []
        details, more, less = [ast.unparse(d) for d in n.decorator_list], {"docstring": ast.get_docstring(n)}, {}
        if coded:
            source = block(n)
            renamed = _renamed(source)
            more |= {"source": source, "hash_exact": _md5(re.sub(r"\s+", " ", source).strip()), "renamed": renamed, "hash_renamed": _md5(renamed)}
        if given:
            add(n, scope, "defaults", n.name, given, details, less)
        if kind == "class":
            add(n, scope, kind, n.name, [ast.unparse(b) for b in n.bases], details, more | {"shape": [m.name for m in n.body if isinstance(m, _FUNCTION)]})
        else:
            more |= {"is_async": type(n) is ast.AsyncFunctionDef, "shape": [type(s).__name__ for s in n.body], "returns": ast.unparse(n.returns) if n.returns else None}
            add(n, scope, kind, n.name, [a.arg for a in n.args.args], details, more)
        return [r[-1] for r in rows[-(1 + bool(given)) :]] if wanted(kind) else [less]

    # Branches so far; of each definition around the node: what its end fills in, the branches before it, its level, the deepest level in it.
    branches, around = 0, []
    todo: list[tuple] = [(c, "", 0) for c in _children(tree)]
    while todo:
        n, scope, level = todo.pop()
        if n is None:
            filled, before, base, deepest = around.pop()
            for more in filled:
                more |= {"complexity": 1 + branches - before, "nesting": deepest - base}
            if around:
                around[-1][3] = max(around[-1][3], deepest)
            continue
        kind = type(n)
        if kind in _DEFINITION:
            around.append([define(n, scope), branches, level, level])
            todo.append((None, "", 0))
            scope = f"{scope}.{n.name}" if scope else n.name
        elif kind is ast.Name:
            add(n, scope, "read" if type(n.ctx) is ast.Load else "write", n.id)
            continue
        elif kind is ast.Attribute:
            add(n, scope, "attribute", n.attr)
        elif kind is ast.Call:
            add(n, scope, "call", getattr(n.func, "id", getattr(n.func, "attr", "")))
            if getattr(n.func, "id", None) == "type":
                add(n, scope, "type_call", "")
        elif kind is ast.Import:
            for a in n.names:
                add(n, scope, "import", a.name, [a.asname or a.name.split(".")[0]])
        elif kind is ast.ImportFrom:
            add(n, scope, "import", "." * n.level + (n.module or ""), [a.asname or a.name for a in n.names], ["from"])
        elif kind is ast.ExceptHandler and n.type is None:
            add(n, scope, "bare_except", "")
        elif kind is ast.Compare and len(n.ops) > 2:
            add(n, scope, "long_comparison", "")
        elif kind is ast.Assign and type(n.value) is ast.Constant and type(n.value.value) is int:
            for t in n.targets:
                if type(t) is ast.Name:
                    add(n, scope, "number", t.id, [str(n.value.value)])
        elif kind is ast.BinOp and type(n.op) is ast.Add and any(type(v) is ast.Constant and isinstance(v.value, str) for v in (n.left, n.right)):
            add(n, scope, "string_sum", "")
        if kind in _FLOW:
            add(n, scope, "flow", kind.__name__.lower())
        elif kind is ast.BinOp or kind is ast.BoolOp:
            op = type(n.op).__name__.lower()
            add(n, scope, "operation", op if op in _OPERATIONS else "binop")
            branches += len(n.values) - 1 if kind is ast.BoolOp else 0
        elif kind is ast.Compare:
            add(n, scope, "operation", "compare")
        branches += kind in _BRANCH
        if kind in _NEST:
            level += 1
            if around:
                around[-1][3] = max(around[-1][3], level)
        todo += [(c, scope, level) for c in _children(n)]
    return rows


#: Entity rows of an Arrow batch, about.
ROWS = 4000


def parse(files: DataFrame, path: str = "path", text: str = "text", columns: Collection[str] | None = None, kinds: Collection[str] | None = None) -> DataFrame:
    """One row per entity of every file, with `columns` (all, if none) of the `kinds` (all, if none): what isn't asked for isn't computed.

    Parsing takes far longer than reading, and a table of many short files may be one split, so files are dealt out first."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [c for c in COLUMNS if columns is None or c in columns]
    ddl = ", ".join(c for c in ENTITY.split(", ") if c.split()[0] in kept)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    coded = not set(_CODE).isdisjoint(kept)
    kinds = None if kinds is None else frozenset(kinds)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        values = dict(zip(_PLAIN, zip(*rows, strict=True), strict=False))
        return pa.RecordBatch.from_arrays([pa.array(values[f.name] if f.name in values else [r[-1].get(f.name) if r[-1] else None for r in rows], f.type) for f in schema], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += entities(p, t, coded, kinds)
                if len(rows) >= ROWS:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return dealt(files.select(F.col(path).alias("path"), F.col(text).alias("text"))).mapInArrow(work, ddl)


def counted(files: DataFrame, path: str = "path", text: str = "text", kinds: Collection[str] | None = None) -> DataFrame:
    """(path, kind, n): how many entities of each of the `kinds` (all, if none) every file has. They are counted where the file
    is parsed, so that what is passed on grows with the files, not with their code."""
    kinds = None if kinds is None else frozenset(kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, k, n) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, n in Counter(r[1] for r in entities(p, t, False, kinds)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "kind", "n"])

    return dealt(files.select(F.col(path).alias("path"), F.col(text).alias("text"))).mapInArrow(work, "path string, kind string, n long")
