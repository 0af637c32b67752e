"""URL filters (4): fixed host and path rules, and association rules; all in DataFrame functions.

A URL is a set of tokens (all labels of the host and its endings, path segments, extension, query
keys). FP-growth mines the token sets that are frequent among the bad ones of the labelled URLs;
tokens that every labelled URL has tell nothing and are left out. A set becomes a rule if its support
is high enough, if its lift is over one beyond doubt (the lower end of the Wilson interval of its
confidence is over `LIFT` times the rate of bad ones among all, each of the frequent sets being tested at `ERROR` divided by their
number), and if neither a rule of fewer
tokens inside it does as well nor a surer one around it explains it. Rules
stand in an inverted index under their rarest token, and URLs look their tokens up there; so a
token that all URLs share brings no rule to all of them unless it is all of a rule. Each found rule
is then checked in full.

Fixed rules come first: a rule fits its host and all subdomains, if the path starts with the rule's;
the longest wins. Where none fits, the verdict is block if an association rule does, else allow.

Cases: a null URL or one without `://` has an empty host and path, no rule and no tokens, and is
allowed; repeated rows are judged each for itself; an id with several labels is bad if any is;
without labels or frequent sets only fixed rules block; an empty table gives no rows; other
columns pass through in the struct `row`, clashing names included; ties of rules need no order, as any
of them blocks; very long URLs give all of their tokens.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.joins import bounded
from tessera.sources.storage import materialize

FIXED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUPPORT, LIFT = 0.002, 1.0
MIN_COUNT = 5
#: Chance that any rule at all is mined from labels that don't depend on the URLs.
ERROR = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules=FIXED) -> Column:
    """The longest rule that fits the columns `host` and `path`, as (rule, verdict); else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of the columns `host` and `path` and the rest of the URL."""
    tag = lambda a, name: F.transform(a, lambda x: F.concat(F.lit(name + ":"), x))
    labels = F.split("host", r"\.")
    segments = F.filter(F.split(F.translate("path", UPPER, LOWER), "/"), lambda x: x != "")
    ends = F.when(F.size(labels) > 2, F.array(F.array_join(F.slice(labels, -2, 2), "."))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), lambda x: x)
    ext = F.regexp_extract_all(F.col("path"), F.lit(r"\.([A-Za-z]{1,5})$"), F.lit(1))
    all_of = F.concat(tag(labels, "host"), tag(ends, "domain"), tag(segments, "path"), tag(keys, "query"), tag(ext, "ext"))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_of))


def mine(labelled: DataFrame, support: float = SUPPORT, lift: float = LIFT, min_count: int = MIN_COUNT, error: float = ERROR) -> DataFrame:
    """(tokens, bad_count, count): rules from `labelled` (tokens array<string>, bad boolean).

    Sets are mined from the bad URLs alone, then counted over all labelled ones through the same
    inverted index that applies them."""
    n_all, n_bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    schema = "tokens array<string>, bad_count long, count long"
    spark = labelled.sparkSession
    if not n_bad:
        return spark.createDataFrame([], schema)
    least = max(float(min_count), support * n_all) / n_bad
    if least > 1:
        return spark.createDataFrame([], schema)
    always = [r["token"] for r in labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") == n_all).collect()]
    labelled = labelled.withColumn("tokens", F.array_except("tokens", F.lit(always).cast("array<string>")))
    bad = labelled.filter("bad and size(tokens) > 0").select("tokens")
    sets = FPGrowth(itemsCol="tokens", minSupport=least, minConfidence=1.0).fit(bad).freqItemsets
    sets = sets.select(F.array_sort("items").alias("set"), F.col("freq").alias("bad_count"))
    sets = materialize(sets, "frequent")
    # Equal bags of tokens are one row with a weight: a host with a third of all rows stays small.
    bags = labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("weight"))
    counted = match(bags, sets).groupBy("set").agg(F.sum("weight").alias("count"))
    rules = sets.join(counted, "set").select(F.col("set").alias("tokens"), "bad_count", "count")
    beyond, z = lift * n_bad / n_all, deviations(error, sets.count())
    good = materialize(rules.withColumn("lower", lower_bound(F.col("bad_count"), F.col("count"), z)).filter(F.col("lower") > beyond), "rules")
    # A rule inside another that is as sure makes the longer one idle; a longer, surer one makes that inside it
    # idle, if what it leaves isn't beyond doubt.
    small = good.select(F.col("tokens").alias("inner"), F.col("lower").alias("sure"), F.col("bad_count").alias("bads"), F.col("count").alias("all"), F.element_at("tokens", 1).alias("head"))
    longer = good.filter(F.size("tokens") > 1).withColumn("head", F.explode("tokens"))
    inside = (F.size("inner") < F.size("tokens")) & (F.size(F.array_except("inner", "tokens")) == 0)
    pairs = materialize(longer.join(small, "head").filter(inside), "inside")
    rest = F.coalesce(lower_bound(F.col("bads") - F.col("bad_count"), F.col("all") - F.col("count"), deviations(error, 2)), F.lit(0.0))
    idle = pairs.filter(F.col("sure") >= F.col("lower")).select("tokens").union(pairs.filter((F.col("sure") < F.col("lower")) & (rest <= beyond)).select("inner")).distinct()
    return good.join(idle, "tokens", "left_anti").select("tokens", "bad_count", "count")


def deviations(error: float, tests: int) -> float:
    """Standard deviations that a normal variable passes with the chance `error` / `tests`."""
    return NormalDist().inv_cdf(1 - error / max(1, tests))


def lower_bound(k: Column, n: Column, z: float) -> Column:
    """The lower end of the Wilson interval, `z` deviations wide to each side, of the share k / n; null if n is 0."""
    p = k / F.nullif(n, F.lit(0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def match(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """`rows` (with `tokens`) once for each set of `sets` (column `set`) inside their tokens. The index
    holds a set under the token that is in the fewest sets."""
    each = sets.select("set", F.explode("set").alias("token"))
    used = each.groupBy("token").agg(F.count("*").alias("uses"))
    index = each.join(used, "token").groupBy("set").agg(F.min(F.struct("uses", "token")).alias("m")).select("set", F.col("m.token").alias("token"))
    looked = rows.withColumn("token", F.explode("tokens")).join(bounded(materialize(index, "index")), "token")
    return looked.filter(F.size(F.array_except("set", "tokens")) == 0).drop("token")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", fixed=FIXED) -> DataFrame:
    """row (the page's columns), host, path, rule, verdict, mined (an association rule fits).

    Verdicts of association rules are found once for each distinct bag of tokens."""
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    parts = pages.select(row, F.col(f"`{url}`").cast("string").alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    known = parts.withColumn("fixed", fixed_rule(fixed))
    if rules.isEmpty():
        hit = known.withColumn("mined", F.lit(False))
    else:
        bags = known.select(F.array_sort(tokens(F.col("url"))).alias("tokens")).distinct()
        found = match(bags, rules.select(F.col("tokens").alias("set"))).select(F.col("tokens").alias("bag")).distinct()
        tokened = known.withColumn("tokens", F.array_sort(tokens(F.col("url"))))
        hit = tokened.join(bounded(materialize(found, "bags")), F.col("tokens") == F.col("bag"), "left").withColumn("mined", F.col("bag").isNotNull())
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    return hit.select("row", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")


def document_number(url: Column) -> Column:
    """The number of the document that a page shows: the first path segment of digits alone, an ending aside."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(?:/[^/?#]*?)*?/([0-9]{1,18})(?:\.[A-Za-z]+)?(?:[/?#]|$)", 1).try_cast("long")


def labelled(pages: DataFrame, labels: DataFrame, bad: Column, shown: Column, url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """(tokens, bad) of the pages with a label. `bad` is an expression over `labels`; `shown`, over `pages`, the
    number of the labelled document that the page shows."""
    marks = labels.select(F.col(label_key).alias("_k"), bad.alias("bad")).filter("_k is not null and bad is not null").groupBy("_k").agg(F.max("bad").alias("bad"))
    urls = pages.select(shown.alias("_p"), F.col(f"`{url}`").cast("string").alias("url")).filter("url is not null")
    joined = urls.join(marks, F.col("_p") == F.col("_k")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    return joined.select(tokens(F.col("url")).alias("tokens"), "bad")
