import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import tokenizer


def sample(n=80):
    rnd = random.Random(9)
    texts = [None, "", " ", "  two  spaces \n\n x", "don't I'll 123,456 <|endoftext|> ok", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\n b <|endof", "é ü 漢字 🙂", "\x00\x1f"]
    for _ in range(n):
        texts.append("".join(rnd.choice(["the ", "Über", " x1", "\n", "...", "  ", "lorem "]) for _ in range(rnd.randrange(600))))
    return texts


@pytest.fixture(scope="module")
def ids():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(own.encode(t, add_special_tokens=False).ids if t else []) + [1] for t in sample()]


@pytest.mark.parametrize("kind", ["ranks", "json"])
def test_round_trip(spark, ids, kind):
    how = tokenizer() if kind == "ranks" else (public_tokenizers.path("byte_bpe_50k.json"), "")
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(sample())], "doc_id long, text string, length int").repartition(4)
    rows = packing.pack(docs, *how, width=256).collect()
    by_doc, line = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        line[r["sequence_id"] * 256 + r["offset"]] = r["length"]
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and r["offset"] + r["length"] <= 256
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert len(by_doc) == len(ids)
    for d, own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids[d]) and all(r["n_pieces"] == len(own) for r in own)
        assert [r["continues"] for r in own] == [True] * (len(own) - 1) + [False]
    at = 0
    for start in sorted(line):
        assert start == at
        at += line[start]


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert packing.pack(docs, *tokenizer()).count() == 3
    assert packing.pack(docs.limit(0), *tokenizer()).count() == 0
