import random

import numpy as np
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.words import space_words


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def brute_fp(text):
    w = space_words(text)
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def sample(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \t", "One", "one two", "ONE two", "É a\x0bb"]
    for _ in range(25):
        t = [rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.randrange(3, 200))]
        texts.append(" ".join(t))
        for _ in range(rnd.randrange(4)):
            u = list(t)
            u[rnd.randrange(len(u))] = "zz"
            texts.append(" ".join(u))
    return texts


def test_fingerprints_and_components(spark):
    texts = sample(1)
    docs = spark.createDataFrame([(i + 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fp(t) for t in texts]
    n = len(texts)
    roots = union(n, [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    assert got == {i + 5: (f"{fps[i]:016x}", roots[i] + 5) for i in range(n)}


def test_long_posting_lists_lose_no_link(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(6))) for b in base for _ in range(80)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([Row(fp=x) for x in signed], "fp long")
    for bits in (1, 2, 3):
        want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits])
        edges = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash.near_fingerprints(nodes, bits).collect()]
        assert all(bin(fps[i] ^ fps[j]).count("1") <= bits for i, j in edges)
        assert union(len(fps), edges) == want


def test_count_filter_drops_pairs_that_meet_too_seldom(spark):
    """Two fingerprints that share five of eight positional bytes meet in lists, but not in enough of them."""
    a = 0x0102030405060708
    fps = {"five": a ^ 0x010101, "six": a ^ 0x0100000100000000, "same block": a ^ 0x0101}
    nodes = spark.createDataFrame([(x, 1) for x in (a, *fps.values())], "fp long, copies long")
    index = simhash.postings(nodes).filter(F.col("fp") != a)
    key = ["c", "v", "p", "b"]
    hub = simhash.postings(nodes).filter(F.col("fp") == a).select(*key, F.col("fp").alias("a"))
    met = index.join(hub, key).select("c", "a", F.col("fp").alias("b"))
    assert {r["b"] for r in met.collect()} == set(fps.values())
    assert {r["b"] for r in simhash.tallied(met).collect()} == {fps["six"], fps["same block"]}


def test_near_texts_keep_one_of_each_group(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts, group = [], []
    for g in range(20):
        t = [word() for _ in range(150)]
        for v in range(rnd.randrange(1, 5)):
            u = list(t)
            if v:
                u[rnd.randrange(150)] = word()
            texts.append(" ".join(u))
            group.append(g)
        if g % 5 == 0:
            texts.append(texts[-1].upper())
            group.append(g)
    texts += ["", None, "short text"]
    group += [97, 97, 98]
    rows = [(i, t, "a", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], (None, texts[0], "b", 1)], "doc_id long, text string, t string, h long")
    kept = simhash.near_texts(docs)
    assert kept.columns == docs.columns
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())


def brute_kept(texts, similarity=0.8):
    sets = [set(simhash.shingle_hashes(space_words(t), 5).tolist()) for t in texts]
    n = len(texts)
    roots = union(n, [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])])
    return {i for i in range(n) if roots[i] == i}


def test_near_texts_find_block_edits_at_the_threshold(spark):
    """Texts with a block of new words at the end or inside, similarities from 0.8 to 0.82."""
    rnd = random.Random(11)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = []
    for g in range(80):
        t = words(124)
        at = rnd.randrange(20, 100)
        texts += [" ".join(t), " ".join(t + words(30 - g % 4)) if g % 2 else " ".join(t[:at] + words(9) + t[at + 9 :])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.near_texts(docs).collect()}
    assert kept == brute_kept(texts) == set(range(0, 160, 2))


def test_near_texts_lose_no_link_in_long_lists(spark):
    """Pairs whose shared rare shingles all stand in many texts that are unlike them, and version chains."""
    rnd = random.Random(12)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(3):
        base, more = words(104), words(56)
        texts += [" ".join(base + words(10)) for _ in range(2)]
        texts += [" ".join(half + more + words(4)) for half in (base[:56], base[48:]) for _ in range(30)]
        t = words(120)
        for _ in range(8):
            texts.append(" ".join(t))
            at, n = rnd.randrange(100), rnd.randrange(4, 12)
            t = t[:at] + words(n) + t[at + n :]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in simhash.near_texts(docs).collect()} == brute_kept(texts)


def test_near_texts_in_a_group_of_two_thousand(spark):
    """Near copies of one text with up to ten changed words each: some are linked, many aren't; brute
    force over all pairs, and far fewer candidates than pairs."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(1999):
        t = list(base)
        for at in rnd.sample(range(150), rnd.randrange(1, 11)):
            t[at] = word()
        texts.append(" ".join(t))
    sets = [np.unique(simhash.shingle_hashes(space_words(t), 5)) for t in texts]
    places = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    held = np.zeros((len(texts), len(places)), np.float32)
    for i, s in enumerate(sets):
        held[i, [places[h] for h in s.tolist()]] = 1
    both, n = held @ held.T, held.sum(1)
    links = np.argwhere(np.triu(both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6, 1)).tolist()
    roots = union(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.near_texts(docs).collect()} == {i for i in range(len(texts)) if roots[i] == i}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.near_texts(docs).count() == 0
