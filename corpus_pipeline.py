"""A training corpus from the documents table, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents, in their order; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, ordinal, packing, simhash
from tessera.llm.queries import tokenizer
from tessera.sources.storage import materialize, table


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is high enough; ratings come from labels."""
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"), ordinal.passed())
    return _columns(ordinal.grade_documents(docs, model).filter("selected"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, but for their first occurrence; so do documents of which nothing
    is left. `n_chars` follows the text."""
    found = linededup.dedup_lines(docs).filter("n_removed < n_lines")
    changed = F.col("n_removed") > 0
    out = []
    for name, kind in docs.dtypes:
        old = F.col("row").getField(name)
        if name == "text":
            old = F.col("clean_text")
        elif name == "n_chars":
            old = F.when(changed, F.char_length("clean_text").cast(kind)).otherwise(old)
        out.append(old.alias(name))
    return found.select(*out)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, similarity 0.8)."""
    return simhash.near_texts(docs, size=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    found = decontam.judged(decontam.find(docs, table(spark, sf_dir, "benchmark")))
    return _columns(found.filter("not contaminated"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, *tokenizer())


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packed)]

#: No stage's method can be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
