"""Continuous ingestion: new files of a folder are chunked and appended to the index batch by batch.

The reference workload is batch only; this is an addition. A micro-batch has a name made of the checkpoint's place and its
number: repeated after a failure, it writes the same batch again, or nothing if it is there, so nothing is indexed twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import split_documents
from ..operators.index import Index


def chunk_rows(pages: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """schemas.CHUNKS of pages (source, page, page_content, metadata)."""
    cut = split_documents(pages, "source", size, overlap)
    known = {k: F.col("metadata")[k] for k in ("arxiv_id", "title", "category")}
    return cut.select(F.concat_ws("#", "source", F.col("chunk_index").cast("string")).alias("chunk_id"), "source", *[v.alias(k) for k, v in known.items()], "page", "chunk_index", "page_content", F.map_filter("metadata", lambda k, _: ~k.isin(*known)).alias("metadata"))


def follow(spark: SparkSession, folder: str, index: Index, checkpoint: str, size: int = 800, overlap: int = 150, available_now: bool = False) -> StreamingQuery:
    """Starts a query over the folder's .txt files; available_now: stops after those that are there."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    pages = files.select(F.col("_metadata.file_path").alias("source"), F.lit(0).alias("page"), F.col("value").alias("page_content"), F.create_map(F.lit("source"), F.col("_metadata.file_path")).alias("metadata"))
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        index.add(chunk_rows(batch, size, overlap), dedup=False, batch=f"stream-{name}-{number:012d}")

    writer = pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
