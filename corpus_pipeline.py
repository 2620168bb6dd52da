"""A training-data pipeline over ``documents``, as stages that are written and reread.

1. toxicity: documents that score as toxic go.
2. ngram_join: of documents linked by 75 percent of their 5-word shingles, the
   one with the smallest id stays.
3. decontamination: documents that hold a benchmark window go.
4. personal_data: spans are replaced by their kind; every document stays.
5. byte_bpe: token ids of each document, decoded again as proof.

Null and empty texts pass every stage, as do null ids and columns that are not
used; rows that repeat an id with the same text are one document from stage 2
on; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontamination, ngram_join, personal_data, toxicity
from tidemark.llm._shared import new_folder, small_batches


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels that are not held out; labels are no input of a score."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))


def _ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    small_batches(spark)
    redacted = personal_data.redact(docs, personal_data.fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", _toxicity),
    ("ngram_join", _ngram_join),
    ("decontamination", _decontamination),
    ("personal_data", _personal_data),
    ("byte_bpe", _byte_bpe),
]

#: SQL can express neither the trained stages nor the encoding; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
