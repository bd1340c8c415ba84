"""Imports: which papers a quota takes, and what becomes of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_modern_id


def search(papers: DataFrame, category: str | None = None, year: int | None = None, limit: int = 50, by: str = "relevance") -> DataFrame:
    """The `limit` first papers of a category, of one year if it is given (0 counts as not given)."""
    found = papers if category is None else papers.where(F.col("category") == category)
    if year:
        found = found.where(F.col("year") == year)
    return found.orderBy(by, "arxiv_id").limit(limit)


def quota(papers: DataFrame, targets: DataFrame, start: int = 2026, end: int = 2000, batch: int = 50) -> DataFrame:
    """category, arxiv_id, place (from 1): year by year, newest first, what a category's target still takes.

    From each year come the first min(batch, missing) papers by relevance; those without a modern id drop out afterwards,
    so a year may bring fewer than it had. papers: category, year, relevance, arxiv_id; targets: category, target. A year
    hands on its first `batch` papers only (ranked within the shuffle), so what a category folds over is bounded: years x
    batch ids.
    """
    rank = F.row_number().over(Window.partitionBy("category", "year").orderBy("relevance", "arxiv_id"))
    first = papers.where(F.col("year").between(end, start)).withColumn("r_", rank).where(F.col("r_") <= batch)
    years = first.groupBy("category", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", "arxiv_id"))), lambda e: e["arxiv_id"]).alias("ids"))
    lists = years.groupBy("category").agg(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("y"), "ids"))).alias("years"))

    def step(acc, e):
        need = F.least(F.lit(batch), F.col("target") - F.size(acc))
        return F.when(F.size(acc) >= F.col("target"), acc).otherwise(F.concat(acc, F.filter(F.slice(e["ids"], F.lit(1), F.greatest(need, F.lit(0))), is_modern_id)))

    taken = lists.join(targets, "category").withColumn("got", F.aggregate("years", F.array().cast("array<string>"), step))
    return taken.select("category", F.posexplode(F.slice("got", 1, F.greatest(F.col("target"), F.lit(0)))).alias("p", "arxiv_id")).select("category", "arxiv_id", (F.col("p") + 1).alias("place"))


def skipped(papers: DataFrame, by: str = "category") -> DataFrame:
    """fetched, valid and skipped papers of each group."""
    valid = F.count_if(is_modern_id(F.col("arxiv_id")))
    return papers.groupBy(by).agg(F.count("*").alias("fetched"), valid.alias("valid"), (F.count("*") - valid).alias("skipped"))


def summary(results: DataFrame, by: str = "category") -> DataFrame:
    """succeeded and failed imports, and their chunks."""
    return results.groupBy(by).agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def payload(papers: DataFrame, category: str | None = None) -> DataFrame:
    """What the catalog takes of papers: authors as one string; a category given for all of them wins."""
    return papers.select("arxiv_id", "title", F.array_join("authors", ", ").alias("authors"), "year", (F.lit(category) if category else F.col("category")).alias("category"), "pdf_path", "txt_path")


def status(results: DataFrame) -> DataFrame:
    """status, message, chunks for each import result."""
    return results.select("arxiv_id", F.when(F.col("success"), "success").otherwise("error").alias("status"), F.when(F.col("success"), F.concat(F.lit("已添加 "), "arxiv_id")).otherwise(F.coalesce("error", F.lit("未知错误"))).alias("message"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
