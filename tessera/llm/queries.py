"""The registered queries of this package: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, collocations, decontam, jaccard, kneser_ney, langid, linededup, ordinal, packing, rules, sharding, simhash, urls
from tessera.sources.storage import materialize, table


def tokenizer() -> tuple[str, str, tuple]:
    """Vocabulary, splitting pattern and special tokens of byte_bpe_50k.json. Its vocabulary is read from the rank
    file, which gives the same ids in a seventh of the time."""
    import public_tokenizers

    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 5, 1)
    model = kneser_ney.train(docs.filter(~held))
    found = kneser_ney.score(docs, model)
    return found.select(
        "row.doc_id", langid.held_out(F.col("row.doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.judged(decontam.find(docs, table(spark, sf_dir, "benchmark")))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated", "spans")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page are those of the document it shows, whose number stands in the URL's path: bad if toxic
    or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    mined = materialize(urls.mine(materialize(urls.labelled(pages, table(spark, sf_dir, "labels"), bad, urls.document_number(F.col("url"))), "labelled")), "urlrules")
    return urls.judge(pages, mined).select("row.page_id", "host", "path", "rule", "verdict", "mined")


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed", F.col("clean_text").alias("text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    scorer = langid.fit(docs.filter(~held & F.col("doc_id").isNotNull()))
    found = langid.predict(docs.select("doc_id", "text"), scorer)
    return found.select("row.doc_id", "lang_pred", "score", "accepted", "bits_per_char", "margin").withColumn("held_out", held)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"), ordinal.passed())
    found = ordinal.grade_documents(docs, model)
    return found.select("row.doc_id", "expected_grade", "p_top", "p_above_worst", "selected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer())


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(rules.statistics(table(spark, sf_dir, "documents")), "stats")
    found = rules.learn(stats, table(spark, sf_dir, "labels"), F.col("quality") == 0)
    columns = ["doc_id", *rules.STATS[:5], "base_failed", "kept", "rule"]
    return rules.judged(stats, found).select(*columns)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by their lowest-scoring cut."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 85 in 100 of their four-word shingles."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers over all documents. A's vocabulary is read from the rank file, which gives
    the ids of byte_bpe_50k.json with special strings as plain text."""
    import public_tokenizers

    files = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    found = alignment.align_corpus(table(spark, sf_dir, "documents"), files)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_urls": op4_urls,
    "op5_linededup": op5_linededup,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_rules": op9_rules,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_jaccard": op12_jaccard,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {}
