"""File sources: text and PDF files as pages, through Spark's readers; the PDF parser is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

#: Files of up to so many bytes count as broken downloads.
LEAST_BYTES = 10_240


def pdf_pages(files: DataFrame, parser: Callable[[bytes], list] = pdf.pdf_pages) -> DataFrame:
    """path, pages (a page without text is an empty one, one that cannot be read null), page_errors (null for pages that can
    be read), error for binary files (path, content). parser: a list of texts, or of exceptions in their place."""
    schema = "path string, pages array<string>, page_errors array<string>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = parser(bytes(content))
                    out.append((path, [None if isinstance(p, Exception) else p or "" for p in found], [f"PDF解析失败: {p}" if isinstance(p, Exception) else None for p in found], None))
                except Exception as e:  # noqa: BLE001  the parser's failures are results
                    out.append((path, None, None, f"PDF解析失败: {e}"))
            yield pd.DataFrame(out, columns=["path", "pages", "page_errors", "error"])

    return files.select("path", "content").mapInPandas(run, schema)


def pdf_text(parsed: DataFrame) -> DataFrame:
    """path, text (all pages, a line break between them), error."""
    return parsed.select("path", F.array_join(F.transform("pages", lambda p: F.coalesce(p, F.lit(""))), "\n").alias("text"), "error")


def load_files(spark: SparkSession, path: str, parser: Callable[[bytes], list] = pdf.pdf_pages) -> DataFrame:
    """source (the whole path), page, page_content, metadata of all .pdf and .txt files of a folder: a row per PDF page, one
    per text file; files of any other name, and of other case, are not accepted.
    PDFs that cannot be parsed give a row with page null and the error in the metadata, pages that cannot be read one with their
    number, no content and the error."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("source"), F.lit(0).alias("page"), F.col("value").alias("page_content"), F.create_map(F.lit("source"), F.col("_metadata.file_path")).alias("metadata"))
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("_metadata.file_path").alias("path"), "content")
    parsed = pdf_pages(binary, parser).withColumn("source", F.col("path"))
    each = parsed.select("source", "error", F.posexplode_outer(F.arrays_zip("pages", "page_errors")).alias("page", "p"))
    failed = F.coalesce("error", "p.page_errors")
    pages = each.select("source", "page", F.col("p.pages").alias("page_content"), F.when(failed.isNull(), F.create_map(F.lit("source"), F.col("source"))).otherwise(F.create_map(F.lit("source"), F.col("source"), F.lit("error"), failed)).alias("metadata"))
    return texts.unionByName(pages)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document, over several lines or not; a path that is not there gives an empty table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema or "value string")
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
