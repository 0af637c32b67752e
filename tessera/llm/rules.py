"""Quality rules (9): learned decision lists over text statistics; all in DataFrame functions.

Statistics of every document are Spark expressions and are written once. Rated documents then teach
an ordered list of conjunctions of thresholds by sequential covering: a rule grows, condition by
condition, by the largest information gain on two thirds of the rated rows, is pruned back to the
prefix that does best on the last third, and takes the rows that it covers out of play. Every step
is one Spark aggregation over the binned statistics; the driver sees only counts by feature and bin.
The list becomes one CASE expression; the first rule that fits decides.

Learning uses at most about `RATED` rated rows, drawn by a hash. Statistics and verdicts cover all
rows and whole texts.

Cases: null and wordless texts have zero counts and fail the base rule; null ratings aren't
learned from; with nothing to learn the list is empty and the base rule alone decides; repeated
rows are judged each for itself; an empty table gives no rows; columns besides the two named aren't
read, clashing names included; very long texts are read whole; of conditions or prefixes of equal worth the first in
order is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.joins import bounded
from tessera.sources.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RATED = 60_000
BINS = 24
MAX_RULES, MAX_CONDITIONS = 8, 3
PRECISION, LEAST = 0.75, 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks")


def _without(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, window: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the columns of `STATS`, all long."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(body, SPACE, -1), lambda x: x != "")
    one = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), words.alias("words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    two = one.select(
        "doc_id",
        F.size("words").alias("n_words"),
        (F.char_length("body") - _without(F.col("body"), SPACES)).alias("word_chars"),
        _without(F.col("body"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        _without(F.col("body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÛÙÑÁÍÓÚ").alias("n_upper"),
        _without(F.col("body"), "!?").alias("n_marks"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("h"),
    )
    grams = F.when(F.col("n_words") > window, F.transform(F.sequence(F.lit(0), F.col("n_words") - window), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    three = two.withColumns({"n_distinct": F.size(F.array_distinct("h")), "g": grams}).drop("h")
    four = three.withColumn("again", F.size(F.array_distinct("g")) < F.size("g"))
    ranked = F.when(F.col("again"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))))
    five = four.withColumn("ranked", ranked).drop("g", "again")
    shifted = F.zip_with(F.slice("ranked", 1, F.size("ranked") - 1), F.slice("ranked", 2, F.size("ranked") - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    six = five.withColumn("twice", F.array_sort(F.array_distinct(F.flatten(F.filter(shifted, lambda x: x.isNotNull()))))).drop("ranked")
    steps = F.zip_with(F.slice("twice", 1, F.size("twice") - 1), F.slice("twice", 2, F.size("twice") - 1), lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.when(F.col("twice").isNull(), 0).otherwise(F.aggregate(steps, F.lit(window), lambda a, x: a + x))
    return six.withColumn("n_repeat_words", covered).select("doc_id", *[F.col(c).cast("long").alias(c) for c in STATS])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules test: figures that don't grow with the length of a text, and the length."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "words_by_line": per("n_words", "n_lines"),
    }


class DecisionList:
    """Ordered rules; each is a list of (feature, '<=' or '>', threshold) with its precision."""

    def __init__(self, rules: list[tuple[list[tuple[str, str, float]], float]]):
        self.rules = rules

    def rejects(self) -> Column:
        """Ordered conditional expression over the statistics: the number of the first rule that fits, or null."""
        out, f = F.lit(None).cast("int"), features()
        for k in range(len(self.rules) - 1, -1, -1):
            fits = F.lit(True)
            for name, op, x in self.rules[k][0]:
                fits = fits & (f[name] <= x if op == "<=" else f[name] > x)
            out = F.when(fits, k).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(f'{a} {o} {x:.4g}' for a, o, x in c)} (precision {p:.3f})" for c, p in self.rules)


def _fits(rule: list[tuple[str, str, int]]) -> Column:
    out = F.lit(True)
    for name, op, k in rule:
        out = out & (F.col(name) <= k if op == "<=" else F.col(name) > k)
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0


def learn(stats: DataFrame, ratings: DataFrame, bad: Column, rated: int = RATED, key: str = "doc_id") -> DecisionList:
    """Sequential covering of the rated rows for which `bad`, an expression over `ratings`, holds. `stats` is a
    written table of `statistics`: filters pushed into its expressions would compute them again and again."""
    marks = ratings.select(F.col(key).alias("_k"), bad.cast("int").alias("bad")).filter("_k is not null and bad is not null")
    share = min(1.0, rated / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    f = features()
    rows = stats.filter(~base_failed()).join(bounded(materialize(marks, "marks")), F.col("doc_id") == F.col("_k"))
    rows = rows.select("bad", F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(3)).alias("third"), *[v.alias(k) for k, v in f.items()])
    rows = materialize(rows, "rated")
    quantiles = [i / BINS for i in range(BINS + 1)]
    # Bad rows are few: their own quantiles are candidates too.
    found = rows.agg(
        *[F.percentile_approx(k, quantiles, 2000).alias(k) for k in f],
        *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(k)), quantiles, 2000).alias(f"bad_{k}") for k in f],
    ).first()
    cuts = {k: sorted(set(found[k] or []) | set(found[f"bad_{k}"] or [])) for k in f}
    binned = {k: sum([(F.col(k) > x).cast("int") for x in c], F.lit(0)).alias(k) for k, c in cuts.items()}
    table = materialize(rows.select("bad", "third", *binned.values()), "binned")

    def counts(where: Column) -> dict[str, dict[int, list[int]]]:
        long = table.filter(where).select("bad", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in f])).alias("x"))
        out: dict[str, dict[int, list[int]]] = {k: {} for k in f}
        for r in long.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():
            out[r["f"]][r["b"]] = [r["p"], r["n"]]
        return out

    rules: list[tuple[list[tuple[str, str, int]], float]] = []
    open_rows = F.lit(True)
    while len(rules) < MAX_RULES:
        rule: list[tuple[str, str, int]] = []
        while len(rule) < MAX_CONDITIONS:
            hist = counts(open_rows & (F.col("third") > 0) & _fits(rule))
            p0, n0 = (sum(v[i] for v in hist[next(iter(f))].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k, bins in hist.items():
                p = n = 0
                for b in range(len(cuts[k])):
                    p, n = p + bins.get(b, [0, 0])[0], n + bins.get(b, [0, 0])[1]
                    best = max(best, (_gain(p0, n0, p, n), (k, "<=", b)), (_gain(p0, n0, p0 - p, n0 - n), (k, ">", b)), key=lambda x: x[0])
            if best[0] <= 0:
                break
            rule.append(best[1])
        if not rule:
            break
        sums = [x for i in range(1, len(rule) + 1) for x in (F.sum(_fits(rule[:i]).cast("int") * F.col("bad")), F.sum(_fits(rule[:i]).cast("int")))]
        got = table.filter(open_rows & (F.col("third") == 0)).agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
        pairs = [(got[2 * i] or 0, got[2 * i + 1] or 0) for i in range(len(rule))]
        worth = [(2 * p - a) / a if a else -1.0 for p, a in pairs]
        i = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, a = pairs[i]
        if p < LEAST or p < PRECISION * a:
            break
        rules.append((rule[: i + 1], p / a))
        open_rows = open_rows & ~_fits(rule[: i + 1])
    return DecisionList([([(k, o, float(cuts[k][b])) for k, o, b in rule], p) for rule, p in rules])


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (number of the rule that rejects) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.rejects()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
