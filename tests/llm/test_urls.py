import itertools
import random
import re

from pyspark.sql import functions as F

from tessera.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for verdict, h, p in urls.FIXED:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


URLS = [
    None, "", "no scheme", "http://", "https://a.example.COM/en/x", "http://www.example.com/en/1?q=1#t", "http://example.com/de/", "http://xexample.com/en/",
    "http://notnet/es/", "http://a.net/es/1", "http://net/fr/", "http://a.net/fr", "http://com", "http://com/", "http://a.b/c://d.net/es/", "http://a.com?x=/en/",
    "ftp://ÄB.net/es/\n://x", "http://a\nb.com/en/", "HTTP://M.EXAMPLE.COM/EN/",
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = urls.mine(pages.limit(0).select(F.array(F.lit("a")).alias("tokens"), F.lit(True).alias("bad")))
    got = {r["row"]["page_id"]: r for r in urls.judge(pages, none).collect()}
    for i, u in enumerate(URLS):
        h, p = split(u)
        want = rule(h, p)
        assert (got[i]["host"], got[i]["path"]) == (h, p), u
        assert (got[i]["rule"], got[i]["verdict"]) == ((want[1], want[0]) if want else (None, "allow")), u


def test_mined_rules_block_bad_combinations(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        host = rnd.choice(["spam", "fine", "good"])
        lang = rnd.choice(["de", "sv"])
        rows.append((i, f"https://{host}.example.org/{lang}/{i}.html?ref={i}"))
        bad = rnd.random() < (0.9 if (host, lang) == ("spam", "sv") else 0.05)
        labels += [(i, int(bad))] * rnd.choice([0, 1, 1, 2])
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    mined = urls.mine(urls.labelled(pages, marks, F.col("toxic") == 1, urls.document_number(F.col("url"))))
    assert [sorted(r["tokens"]) for r in mined.collect()] == [["host:spam", "path:sv"]]
    got = {r["row"]["page_id"]: r["verdict"] for r in urls.judge(pages, mined).collect()}
    assert got == {i: "block" if "spam" in u and "/sv/" in u else "allow" for i, u in rows}


def test_mining_against_brute_force(spark):
    """All frequent sets, their counts, bounds and both prunings, from plain loops."""
    rnd = random.Random(4)
    rows = [([t for t in "abcdefghijkl" if t == "a" or rnd.random() < 0.3], rnd.random()) for _ in range(400)]
    rows = [(t, x < (0.7 if {"b", "c"} <= set(t) else 0.45 if "d" in t else 0.15)) for t, x in rows]
    got = {(tuple(sorted(r["tokens"])), r["bad_count"], r["count"]) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    bad = sum(b for _, b in rows)

    def lower(k, n, tests=None):
        p, z = k / n, urls.deviations(urls.ERROR, tests or len(counts))
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    counts = {}
    for size in range(1, 12):
        for s in itertools.combinations("bcdefghijkl", size):
            k = sum(b for t, b in rows if set(s) <= set(t))
            if k >= urls.MIN_COUNT:
                counts[s] = (k, sum(set(s) <= set(t) for t, _ in rows))
    good = {s: kn for s, kn in counts.items() if lower(*kn) > bad / len(rows)}
    sure = {s: lower(*kn) for s, kn in good.items()}
    idle = set()
    for s in good:
        for r in good:
            if set(r) < set(s):
                k, n = (x - y for x, y in zip(good[r], good[s], strict=True))
                if sure[r] >= sure[s]:
                    idle.add(s)
                elif (lower(k, n, 2) if n else 0) <= bad / len(rows):
                    idle.add(r)
    assert got == {(s, *good[s]) for s in good if s not in idle}
    assert ("b", "c") in {s for s, _, _ in got}


def test_document_numbers(spark):
    want = {
        "http://a.b/en/825?page=2": 825, "https://a/12/x/13": 12, "https://a.c/en/7.html": 7, "http://a/en/9#top": 9, "http://a/en/9/": 9,
        "http://a/en?x=/5/": None, "http://5/en": None, "no/5": None, "http://a/x5/y": None, "http://a/" + "9" * 30: None,
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["n"] for r in rows.select("url", urls.document_number(F.col("url")).alias("n")).collect()} == want


def test_counts_of_sets_are_exact(spark):
    bags = spark.createDataFrame([(["a", "b", "c"], 2), (["a"], 5), ([], 1), (["b", "c"], 1)], "tokens array<string>, weight long")
    sets = spark.createDataFrame([(["a"],), (["b", "c"],), (["a", "c"],), (["d"],)], "set array<string>")
    got = {tuple(r["set"]): r["n"] for r in urls.match(bags, sets).groupBy("set").agg(F.sum("weight").alias("n")).collect()}
    assert got == {("a",): 7, ("b", "c"): 3, ("a", "c"): 2}


def test_labels_that_do_not_depend_on_urls_give_no_rules(spark):
    """Of twelve shuffles one may give rules by chance."""
    rnd, found = random.Random(9), 0
    rows = [([f"host:{rnd.choice('abcdefgh')}", f"path:{rnd.choice('pqrstu')}", f"ext:{rnd.choice('xyz')}"], rnd.random() < 0.25) for _ in range(960)]
    for _ in range(12):
        marks = [b for _, b in rows]
        rnd.shuffle(marks)
        frame = spark.createDataFrame([(t, b) for (t, _), b in zip(rows, marks, strict=True)], "tokens array<string>, bad boolean")
        found += not urls.mine(frame).isEmpty()
    assert found <= 1
