"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, bpe, collocations, decontaminate, html_extract, langid, license_scan, neural_lm, ngram_join, pii, quality, sql, token_store


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_query,
        "op2_token_shards": token_store.op2_query,
        "op3_ann": ann.op3_query,
        "op4_html_extract": html_extract.op4_query,
        "op5_pii_surrogates": pii.op5_query,
        "op6_ngram_join": ngram_join.op6_query,
        "op7_decontaminate": decontaminate.op7_query,
        "op8_langid": langid.op8_query,
        "op9_license_scan": license_scan.op9_query,
        "op10_quality": quality.op10_query,
        "op11_gated_lm": neural_lm.op11_query,
        "op12_collocations": collocations.op12_query,
        "op13_alignment": align.op13_query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
