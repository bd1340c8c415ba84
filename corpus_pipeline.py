"""A corpus pipeline: language, near copies, benchmark passages, personal data, token ids."""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, decontaminate, langid, ngram_join, pii
from lorekeep.llm.common import drop_stored, free_name, scratch, table

#: DuckDB SQL for run()'s rows: none, as SQL expresses no trained classifier.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; texts without a letter (null and empty ones too) go. Repeated rows share
    their lot; rows with a null doc_id are judged like others. Results replace no column."""
    return langid.known_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at 0.8 or more. Texts without words, null ones
    too, are groups of their own; rows without a doc_id stay; repeated rows with the kept doc_id all stay, as they are one
    document."""
    return ngram_join.keep_one(docs, width=5, num=80, den=100)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Null and empty texts hold none and stay; an empty
    benchmark drops nothing; repeated rows share their lot."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars, if there is such a column, follows the new text. Null and empty texts stay as they
    are, and equal rows become equal rows."""
    done = pii.pseudonymised(docs, pii.configured_key(spark), count=free_name(docs, "n_entities"))
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of decoded bytes, for every row; null texts count as empty."""
    return bpe.round_trip(docs.select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).drop("text")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_stored(spark, before)
        before = path
    return docs
