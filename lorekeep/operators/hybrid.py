"""Hybrid search: both legs fetch 2k candidates; texts that either returns share one weighted score.

Copies of a text behave differently in the two legs: of vector hits the farthest copy counts, of BM25 hits every copy adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from .knn import within

def vector_leg(hits: DataFrame, weight: float = 0.7, cutoff: float = 1.5) -> DataFrame:
    """hits: qid, id, d2, rk (the nearest 2k of each question). The cutoff comes after the limit."""
    return within(hits, cutoff).select("qid", "id", (weight * similarity(F.col("d2"))).alias("vs"), F.lit(None).cast("double").alias("bs"), F.col("rk").alias("vr"), F.lit(None).cast("int").alias("br"))


def bm25_leg(scores: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """scores: qid, id, s. Each question's best score over all documents scales the others; equal scores go to the larger id,
    as a reversed stable sort would have it (to 9 digits: sums of equal parts differ by their order in the last ones);
    scores of 0 and less drop out."""
    by = Window.partitionBy("qid")
    top = scores.groupBy("qid").agg(F.max("s").alias("top"))
    best = scores.withColumn("rk", F.row_number().over(by.orderBy(F.desc(F.round("s", 9)), F.desc("id")))).where(F.col("rk") <= 2 * k)
    norm = F.col("s") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)
    return best.join(top, "qid").where("s > 0").select("qid", "id", F.lit(None).cast("double").alias("vs"), (weight * norm).alias("bs"), F.lit(None).cast("int").alias("vr"), F.col("rk").alias("br"))


def fuse(docs: DataFrame, vector: DataFrame | None, bm25: DataFrame | None, k: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """qid, rank, text, score, vec_rank, bm25_rank, id of the k best texts of each question. A missing leg adds nothing, and
    the weights stay as they are. The kept document is the last vector copy, else the first BM25 copy."""
    legs = [x for x in (vector, bm25) if x is not None]
    if not legs:
        return docs.sparkSession.createDataFrame([], "qid long, rank int, text string, score double, vec_rank int, bm25_rank int, id long")
    hits = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    # at most 4k hits a question: Spark sees their size at run time and sends them to the documents if that is cheaper
    texts = hits.join(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "id")
    kept = F.coalesce(F.max_by("id", "vr"), F.min_by("id", "br"))
    grouped = texts.groupBy("qid", "text").agg((F.coalesce(F.min("vs"), F.lit(0.0)) + F.coalesce(F.sum("bs"), F.lit(0.0))).alias("score"), F.min("vr").alias("vec_rank"), F.min("br").alias("bm25_rank"), kept.alias("id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("vec_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "text", "score", "vec_rank", "bm25_rank", "id")
