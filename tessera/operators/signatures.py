"""What functions do: signatures of calls, control flow and operations, and how alike two signatures are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, mean_of, split_name, tokens
from tessera.operators.similarity import sequence_ratio

#: Words of documentation that don't count; marks of the kinds of flow; weights and levels of a match.
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall
can to of in for on with at by from as into through during before after above below between under again further then once
here there when where why how all each few more most other some such no nor not only own same so than too very just and
but if or because until while this that these those""".split()
FLOW = {"if": "i", "for": "f", "while": "w", "try": "t", "with": "h"}
WEIGHTS = {"structural": 0.3, "behavioural": 0.3, "named": 0.25, "documented": 0.15}
LEVELS = {"exact": 0.95, "similar": 0.75, "related": 0.5}
#: Documentation of neither, of one.
NO_DOCS, ONE_DOC = 0.5, 0.3
#: What `signatures` reads of entity rows: columns and kinds.
READS = ("path", "kind", "name", "scope", "lineno", "end_lineno", "args", "details", "docstring", "returns"), ("function", "call", "read", "write", "flow", "operation")


def signatures(entities: DataFrame) -> DataFrame:
    """One row per function: path, lineno, name, args (without self and cls), decorators (plain names), returns, calls,
    variables (both sorted, distinct), flow (in order), operations (sorted, repeats stay), words, parts, digest.

    A body holds what stands between a function's first and last line, nested functions included. Rows of a file meet their
    functions on (path, scope), once for each scope around them, and are gathered by one shuffle, so that a function's arrays
    grow with the text of its name's definitions only. A name that a file defines twice in one scope is told apart by lines. Functions without a body of that kind have empty arrays; error rows give none."""
    none = F.array().cast("array<string>")
    qualified = F.when(F.coalesce("scope", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name"))
    plain = F.filter(F.transform(F.coalesce("details", none), lambda d: F.regexp_extract(d, r"^([A-Za-z_]\w*)(\([\s\S]*)?$", 1)), lambda d: d != "")
    functions = entities.filter("kind = 'function'").select(
        "path", "lineno", "end_lineno", "name", qualified.alias("q"), F.filter(F.coalesce("args", none), lambda a: ~a.isin("self", "cls")).alias("args"), plain.alias("decorators"), "returns",
        tokens(F.coalesce("docstring", F.lit("")), 2, STOP_WORDS).alias("words"), split_name(F.col("name")).alias("parts"),
    )
    held = entities.filter(F.col("kind").isin("call", "read", "write", "flow", "operation") & (F.coalesce("scope", F.lit("")) != "") & (F.col("name") != ""))
    steps = F.split("scope", r"\.")
    around = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "."))
    kind = F.when(F.col("kind").isin("read", "write"), "variable").otherwise(F.col("kind"))
    # Functions and what their bodies hold meet in one grouping; those of one name in one scope don't overlap.
    given = functions.select("path", "q", F.struct(*[c for c in functions.columns if c not in ("path", "q")]).alias("f"), F.lit(None).cast("struct<kind:string,line:int,held:string>").alias("b"))
    inner = held.select("path", F.explode(around).alias("q"), F.lit(None).cast(given.schema["f"].dataType).alias("f"), F.struct(kind.alias("kind"), F.col("lineno").alias("line"), F.col("name").alias("held")).alias("b"))
    grouped = given.unionByName(inner).groupBy("path", "q").agg(F.collect_list("f").alias("f"), F.collect_list("b").alias("b")).filter(F.size("f") > 0)
    single = grouped.select("path", "q", "b", F.explode("f").alias("f")).select("path", "f.*", F.filter("b", lambda x: x["line"].between(F.col("f.lineno"), F.col("f.end_lineno"))).alias("b"))
    of = lambda k: F.filter("b", lambda x: x["kind"] == k)
    names = lambda rows: F.transform(rows, lambda x: x["held"])
    filled = single.withColumns({
        "calls": F.array_sort(F.array_distinct(names(of("call")))), "variables": F.array_sort(F.array_distinct(names(of("variable")))),
        "flow": names(F.array_sort(of("flow"))), "operations": F.array_sort(names(of("operation"))),
    })
    listed = [F.array_join(F.array_sort(c), ",") for c in ("args", "decorators", "calls", "flow")]
    digest = F.substring(F.md5(F.concat_ws("|", F.lit("function"), *listed)), 1, 16)
    return filled.select("path", "lineno", "name", "args", "decorators", "returns", "calls", "variables", "flow", "operations", "words", "parts", digest.alias("digest"))


def twins(found: DataFrame) -> DataFrame:
    """digest, n, files, first (path, lineno, name) of signatures that several functions share. Counts and minima only: a
    signature of any number of functions is no larger than one of two."""
    by_file = found.groupBy("digest", "path").agg(F.count("*").alias("n"), F.min(F.struct("path", "lineno", "name")).alias("first"))
    return by_file.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.min("first").alias("first")).filter("n > 1")


def likeness(x: str, y: str) -> dict[str, Column]:
    """The four parts of a match of the signatures with the aliases `x` and `y`."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    most = F.greatest(F.size(a("args")), F.size(b("args")))
    count = F.when(most == 0, 1.0).otherwise(F.least(F.size(a("args")), F.size(b("args"))) / most)
    shared = lambda c, none: F.coalesce(jaccard(a(c), b(c)), F.lit(none))
    returns = F.when((a("returns") != "") & (b("returns") != ""), F.when(a("returns") == b("returns"), 1.0).otherwise(0.5))
    marks = F.create_map(*[F.lit(v) for kv in FLOW.items() for v in kv])
    ways = lambda c: F.array_join(F.transform(c, lambda k: marks[k]), "")
    behaviour = mean_of(shared("calls", 1.0), sequence_ratio(ways(a("flow")), ways(b("flow"))), shared("operations", 1.0))
    by_parts = F.coalesce(jaccard(a("parts"), b("parts")), F.lit(0.5))
    named = F.when(a("name") == b("name"), 1.0).otherwise(F.greatest(by_parts, sequence_ratio(F.lower(a("name")), F.lower(b("name")))))
    some, other = F.size(a("words")) > 0, F.size(b("words")) > 0
    documented = F.when(~some & ~other, NO_DOCS).when(~some | ~other, ONE_DOC).otherwise(jaccard(a("words"), b("words")))
    return {"structural": mean_of(count, shared("decorators", 1.0), returns), "behavioural": behaviour, "named": named, "documented": documented}


def matches(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """The rows of `pairs`, which holds two signatures under the structs `x` and `y`: structural, behavioural, named, documented,
    overall (all rounded to 4 places), level (exact, similar, related, different) and evidence, after the other columns of `pairs`."""
    rest = [c for c in pairs.columns if c not in (x, y)]
    parts = likeness(x, y)
    scored = pairs.select("*", *[v.alias(k) for k, v in parts.items()])
    overall = sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    level = F.lit(None).cast("string")
    for name, least in reversed(LEVELS.items()):
        level = F.when(overall >= least, name).otherwise(level)
    both = F.array_intersect(F.col(f"{x}.calls"), F.col(f"{y}.calls"))
    said = F.filter(
        F.array(
            F.when(F.col("structural") > 0.8, "structure"), F.when(F.col("behavioural") > 0.8, "behaviour"), F.when(F.col("named") > 0.7, "name"),
            F.when(F.col("documented") > 0.5, "documentation"), F.when(F.size(both) > 3, "calls"),
        ),
        lambda e: e.isNotNull(),
    )
    return scored.select(*rest, x, y, *[F.round(k, 4).alias(k) for k in parts], F.round(overall, 4).alias("overall"), F.coalesce(level, F.lit("different")).alias("level"), said.alias("evidence"))
