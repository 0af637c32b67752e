"""Collocations against a plain version with Python's own counters and whole numbers."""

import collections
import random
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tests_data import DATA

from tessera.llm import collocations, queries

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, words=3, least=10, top=2000, contained=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                gone |= {q for i in range(len(p) - k + 1) if (q := p[i : i + k]) in candidates and 100 * a >= contained * candidates[q]}
        kept = []
        for p, a in candidates.items():
            if p not in gone:
                s, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-s, -a, b" ".join(p), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_equals_plain_version_on_documents(spark):
    t = pq.read_table(f"{DATA}/documents.parquet")
    rows = list(zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert found(collocations.collocations(frame(spark, rows).repartition(4), shard_words=40_000)) == brute(rows)


def test_varied_bounds_and_texts(spark):
    rnd = random.Random(3)
    words = ["a", "B", "b", "ab", "É", "é", " x", "\x01", "日本"]
    rows = [(rnd.choice(["en", "de", None, ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "?!"]) for _ in range(rnd.randrange(120)))) for _ in range(300)] + [("en", None), (None, ""), ("fr", ".,;")]
    for k, least, top, contained in ((3, 10, 2000, 50), (4, 5, 20, 90), (2, 2, 7, 50)):
        assert found(collocations.collocations(frame(spark, rows), k, least, top, contained, shard_words=300)) == brute(rows, k, least, top, contained)


def test_ngrams_of_a_shard():
    rng = np.random.default_rng(2)
    for trial in range(30):
        text = np.concatenate([[0], rng.integers(0, 2 + trial, 300), [0]])
        want = collections.Counter(tuple(g) for k in (2, 3, 4) for i in range(len(text) - k + 1) if (g := text[i : i + k].tolist()) and all(g))
        got = {tuple(g): n for grams, counts in collocations.ngrams(text, 4) for g, n in zip(grams.tolist(), counts.tolist(), strict=True)}
        assert got == dict(want)


def test_both_directions_stay_in_step():
    text = np.array([0, 1, 2, 1, 2, 3, 0, 2, 1, 2, 0, 3, 1, 2, 3, 0])
    index = collocations.BiIndex(text, 3)
    word, rows = index.words()
    s, left, by_left = index.extend(rows, left=True)
    t, right, by_right = index.extend(rows, left=False)
    one = {(int(a), int(b)): r.tolist() for a, b, r in zip(left, word[s], by_left, strict=True)}
    two = {(int(a), int(b)): r.tolist() for a, b, r in zip(word[t], right, by_right, strict=True)}
    assert one == two


def test_large_numbers_are_exact(spark):
    rows = [(3_000_000_007, 3_000_000_011, 3_000_000_019), (10**15 - 1, 10**15, 10**15), (9_999_999, 10**7, 10**7), (10, 10, 10**18)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (b * c) for a, b, c in rows]


def test_cases(spark):
    kind = "lang string, text string, phrase string, n int"
    assert collocations.collocations(spark.createDataFrame([], kind)).count() == 0
    long_text = "New York is big. " * 60_000
    got = found(collocations.collocations(spark.createDataFrame([("en", long_text, "x", 1), (None, None, None, None), (None, "alone", "y", 2)], kind)))
    assert got == brute([("en", long_text)]) and ("en", 1, "is big", 60_000, 60_000, 60_000, 240_000, 1_000_000) not in got
    assert queries.QUERIES["op11_collocations"]


def test_shards_send_a_row_for_each_chunk_of_hashes():
    """A shard's hashes leave their task in at most as many rows as the bitmap has chunks, none lost."""
    import numpy as np

    from tessera.llm import collocations

    rnd = np.random.default_rng(3)
    h, n = rnd.integers(0, 1 << 64, 50_000, np.uint64), rnd.integers(1, 1000, 50_000)
    for size in (0, 1, 50_000):
        rows = collocations._parted(h[:size], n[:size]).to_pylist()
        assert len(rows) == len({r["chunk"] for r in rows}) <= 1 << collocations.HOT_BITS - collocations.CHUNK
        got = [(x, y, r["chunk"]) for r in rows for x, y in zip(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int32), strict=True)]
        assert sorted(got) == sorted((x, y, x >> np.uint64(52)) for x, y in zip(h[:size], n[:size], strict=True))


def test_hot_bits_are_those_of_all_sums(spark):
    from tessera.llm import collocations

    texts = [("a b c", "x")] * 6 + [("a b", "x")] * 4 + [("a b", "y")] * 9 + [(f"w{i}", "y") for i in range(50)]
    bits = collocations.hot_bits(spark.createDataFrame(texts, "text string, lang string").repartition(7), 10, 4)
    own = lambda lang, w: collocations.hashes(lang, [w])
    pair = collocations.pair_hash(own("x", b"a"), own("x", b"b"))
    at = {int(x[0] >> collocations.np.uint64(64 - collocations.HOT_BITS)) for x in (own("x", b"a"), own("x", b"b"), pair)}
    assert set(collocations.np.flatnonzero(collocations.np.unpackbits(bits, bitorder="little")).tolist()) == at
