import json

import duckdb
import pytest

from tests_data import DATA

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        from tessera.sources.storage import materialize

        out.append(materialize(stage(spark, out[-1], DATA), name))
    return out


def test_stages_follow_each_other(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    counts = [s.select("doc_id").distinct().count() for s in steps]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] == counts[5] > counts[0] // 2


def test_quality_rejects_bad_and_keeps_good(steps):
    kept = {r["doc_id"] for r in steps[1].select("doc_id").collect()}
    rated = duckdb.sql(f"select doc_id, quality, toxic from '{DATA}/labels.parquet'").fetchall()
    good = [d in kept for d, q, t in rated if q and not t]
    bad = [d in kept for d, q, t in rated if not q or t]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_near_and_benchmark_stages_against_brute_force(steps):
    from test_decontam import brute

    from tessera.llm.simhash import shingle_hashes
    from tessera.llm.words import space_words

    before = {r["doc_id"]: set(shingle_hashes(space_words(r["text"]), 5).tolist()) for r in steps[2].collect()}
    ids, root = sorted(before), {}
    index = {}
    for d in ids:
        for h in before[d]:
            index.setdefault(h, []).append(d)

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    pairs = {(a, b) for own in index.values() for a in own for b in own if a < b} | {(a, b) for a in ids for b in ids if a < b and not before[a] and not before[b]}
    for a, b in pairs:
        both = len(before[a] & before[b])
        if both >= 0.8 * (len(before[a] | before[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = {r["doc_id"] for r in steps[3].collect()}
    assert kept == {find(d) for d in ids}
    rows = steps[3].collect()
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    found = brute([r["text"] for r in rows], items)
    clean = {r["doc_id"] for r, (n, hit, _) in zip(rows, found, strict=True) if not (hit and 20 * hit >= n)}
    assert {r["doc_id"] for r in steps[4].collect()} == clean
    assert json.dumps(sorted(clean))


def test_packed_pieces_are_whole(steps):
    pieces = [r.asDict() for r in steps[5].collect()]
    places = sorted((p["sequence_id"] * 2048 + p["offset"], p["length"]) for p in pieces)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
