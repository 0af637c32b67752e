"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeats, clashing columns and empty tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, kneser_ney, langid, linededup, ordinal, packing, rules, sharding, simhash, urls
from tessera.llm.queries import tokenizer
from tessera.sources.storage import materialize

LONG = "lorem ipsum dolor sit amet " * 4_000
PHRASE = " ".join(f"phrase{k}" for k in range(13))
TEXTS = [None, "", " \n\t ", LONG, "x" * 50_000, "a b c d e f", "a b c d e f", "é 漢字 🙂", "one\n\ntwo\n\none", PHRASE, PHRASE + " more"]
#: Clashing names: those of the operators' own columns.
NAMES = ["row", "body", "h", "t", "i", "fp", "n", "id", "k", "doc", "part", "spans", "score", "words", "lines", "bad", "host", "path", "rule", "size"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "null id", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES]).repartition(3)


def marks(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(11)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, PHRASE), (2, PHRASE), (3, None), (None, "")], "item_id long, text string")


def judged_by_rules(docs, ratings):
    stats = materialize(rules.statistics(docs), "stats")
    return rules.judged(stats, rules.learn(stats, ratings, F.col("quality") == 0))


OPS = {
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near_texts": lambda s, d: simhash.near_texts(d),
    "lm": lambda s, d: kneser_ney.score(d, kneser_ney.train(d)),
    "decontam": lambda s, d: decontam.judged(decontam.find(d, bench(s))),
    "linededup": lambda s, d: linededup.dedup_lines(d),
    "langid": lambda s, d: langid.predict(d, langid.fit(d.filter("doc_id is not null"))),
    "ordinal": lambda s, d: ordinal.grade_documents(d, ordinal.fit(d, marks(s), ordinal.passed(), steps=4)),
    "packing": lambda s, d: packing.pack(d, *tokenizer()),
    "rules": lambda s, d: judged_by_rules(d, marks(s)),
    "sharding": lambda s, d: sharding.shard(d),
    "urls": lambda s, d: urls.judge(d, s.createDataFrame([(["host:a"], 1, 1)], "tokens array<string>, bad_count long, count long"), url="text"),
}


@pytest.mark.parametrize("name", OPS)
def test_one_result_per_row(spark, docs, name):
    got = OPS[name](spark, docs).collect()
    key = lambda r: r["doc_id"] if "doc_id" in r.asDict() else r["row"]["doc_id"]
    if name == "near_texts":
        assert {r["doc_id"] for r in got} >= {0, 3, 4, 5, 7, 8, 9}
        assert {r["doc_id"] for r in got} & {1, 2, 6} == set() and got[0]["row"] == "own row"
        return
    ids = sorted((key(r) is None, key(r) or 0) for r in got)
    if name == "packing":
        assert {i for _, i in ids} == set(range(11)) and sum(r["start"] == 0 for r in got) == 14
        return
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
    if name == "sharding":
        assert {r["text_crc32"] for r in got if r["doc_id"] == 3} == {zlib.crc32(LONG.encode())}
    elif name == "simhash":
        by = {r["doc_id"]: r for r in got}
        assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0 and by[6]["component_id"] == 5
    elif name == "lm":
        by = {r["row"]["doc_id"]: r for r in got}
        assert by[0]["n_tokens"] == by[2]["n_tokens"] == 1 and by[3]["n_tokens"] == 20_001 and by[5]["score"] == by[6]["score"]
        assert by[3]["row"]["score"] == "own score"
    elif name == "decontam":
        by = {r["row"]["doc_id"]: r for r in got}
        assert by[9]["item_ids"] == by[10]["item_ids"] == ["1", "2"] and by[9]["n_hit"] == 13 and by[3]["n_words"] == 20_000
        assert {i for i, r in by.items() if r["contaminated"]} == {9, 10}
    elif name == "linededup":
        by = {r["row"]["doc_id"]: r for r in got if r["row"]["doc_id"] is not None}
        assert by[0]["clean_text"] is None and by[3]["clean_text"] == LONG and by[5]["row"]["lines"] == "own lines"
    elif name == "langid":
        assert {r["lang_pred"] for r in got if r["row"]["doc_id"] in (0, 1, 2)} == {"und"}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, docs, name):
    assert OPS[name](spark, docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    marks(spark).write.parquet(f"{path}/labels.parquet")
    bench(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, folder, stage):
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == docs.columns
    got = [r["doc_id"] for r in found.collect()]
    if stage == "benchmark":
        assert sorted(i for i in got if i is not None) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    elif stage == "near":
        assert not {1, 2, 6} & set(got) and {0, 3, 4, 5, 7, 8, 9} <= set(got)
    elif stage == "packing":
        assert set(got) == {*range(11), None}
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), folder).count() == 0
