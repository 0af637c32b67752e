import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025, 65537])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    p = sharding.permute(x, n)
    assert sorted(p.tolist()) == x.tolist()
    assert (sharding.permute(p, n, back=True) == x).all()
    if n >= 1000:
        assert abs(np.corrcoef(x, p)[0, 1]) < 0.1 and (sharding.permute(x, n, seed=1) != p).mean() > 0.9


def test_law_and_columns(spark):
    texts = [None, "", "é", "same", "same"] + [f"t{i % 40}" for i in range(300)]
    rows = [(i // 2 if i < 20 else i, t, "x") for i, t in enumerate(texts)] + [(None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(docs.repartition(5), shards=8, partitions=3).collect()
    again = sharding.shard(docs.repartition(2), shards=8, partitions=6).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again)), "the order of the input doesn't matter"
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    n = len(rows)
    for r in got:
        p = int(sharding.permute(np.array([r["row_no"]]), n)[0])
        assert (p % 8, p // 8) == (r["shard"], r["slot"])
    assert sharding.shard(docs.limit(0)).count() == 0
