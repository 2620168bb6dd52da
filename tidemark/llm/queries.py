"""The contract queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, byte_bpe, decontamination, ngram_join, periodic, personal_data, piece_bpe, quality_rules, repeats, site_quality, token_store, toxicity, warc
from tidemark.llm._shared import new_folder, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every whole text of ``documents`` as token files, and read them back."""
    path = new_folder(spark, "tokens")
    token_store.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read(spark, path)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` that share 75 percent of their 5-word shingles."""
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every ``benchmark`` window in every whole text of ``documents``."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents`` with its source and language as site and section."""
    docs = _table(spark, sf_dir, "documents")
    return site_quality.judge(docs, site_quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``, learning from the labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.tag(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return byte_bpe.round_trip(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, and read all records back through the index."""
    return warc.read(warc.write(_table(spark, sf_dir, "pages")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and robust outliers over every whole text of ``documents``."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that a repeated string of 200 bytes covers."""
    return repeats.remove(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every whole text of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    return personal_data.report(docs, personal_data.fit(docs))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of a byte-level and a piece vocabulary in every whole text of ``documents``."""
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.report(_table(spark, sf_dir, "documents"), *paths)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents`` by pieces, and decode it."""
    return piece_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text of ``documents``, a tenth of which are made periodic first."""
    return periodic.report(_table(spark, sf_dir, "documents"), plant=periodic.planted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to query."""
    return {f.__name__: f for f in (op1_token_store, op2_ngram_join, op3_decontamination, op4_site_quality, op5_toxicity, op6_byte_bpe, op7_warc, op8_quality_rules, op9_repeats, op10_personal_data, op11_alignment, op12_piece_bpe, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express on whole tables."""
    return {"op3_decontamination": decontamination.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL}
