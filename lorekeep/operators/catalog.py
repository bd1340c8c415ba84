"""The paper catalog: snapshots with upsert semantics, marks, title lookups, DDL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import without_txt
from ..session import work_path, written

#: Parts of the catalog, by a hash of the id; what is changed is rewritten by whole buckets.
BUCKETS = 64

#: Columns that an upsert takes from the new row if the key is known; all others keep their values.
UPDATED = ("title", "authors", "year")


def upsert(catalog: DataFrame, new: DataFrame, now=None) -> DataFrame:
    """The catalog after inserting `new` (arxiv_id, title, authors, year, category, pdf_path, txt_path).

    Known ids only take the new title, authors and year. Of several new rows with one id, the first inserts and the last
    updates, as statements in their order (column `seq`, if there is one) would. Rows without an id are left out.
    """
    now = F.current_timestamp() if now is None else now
    seq = F.col("seq") if "seq" in new.columns else F.lit(0)
    given = new.where("arxiv_id is not null").withColumn("seq", seq)
    order = Window.partitionBy("arxiv_id")
    firsts = given.withColumn("r_", F.row_number().over(order.orderBy("seq")))
    lasts = given.groupBy("arxiv_id").agg(*[F.max_by(c, "seq").alias(f"l_{c}") for c in UPDATED])
    fresh = firsts.where("r_ = 1").join(lasts, "arxiv_id").select("arxiv_id", *[F.col(f"l_{c}").alias(c) for c in UPDATED], "category", "pdf_path", "txt_path")
    n = fresh.select([F.col(c).alias(f"n_{c}") for c in fresh.columns])
    joined = catalog.withColumn("known_", F.lit(True)).join(n, F.col("arxiv_id") == F.col("n_arxiv_id"), "full_outer")
    known, met = F.col("known_").isNotNull(), F.col("n_arxiv_id").isNotNull()

    def value(c: str):
        if c in ("title", "authors", "year"):
            return F.when(met, F.col(f"n_{c}")).otherwise(F.col(c))
        if c in ("category", "pdf_path", "txt_path"):
            return F.when(known, F.col(c)).otherwise(F.col(f"n_{c}"))
        if c == "is_vectorized":
            return F.when(known, F.col(c)).otherwise(F.lit(False))
        if c == "created_at":
            return F.when(known, F.col(c)).otherwise(now)
        return F.coalesce("arxiv_id", "n_arxiv_id") if c == "arxiv_id" else F.col(c)

    return joined.select(*[value(c).alias(c) for c in catalog.columns])


def mark_vectorized(catalog: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """The catalog with is_vectorized set for these ids; none of them: unchanged."""
    if isinstance(ids, list):
        return catalog if not ids else catalog.withColumn("is_vectorized", F.when(F.col("arxiv_id").isin(ids), True).otherwise(F.col("is_vectorized")))
    marks = ids.select("arxiv_id").distinct().withColumn("mark_", F.lit(True))
    return catalog.join(marks, "arxiv_id", "left").withColumn("is_vectorized", F.coalesce("mark_", "is_vectorized")).select(*catalog.columns)


def titles(catalog: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """arxiv_id, title of the requested ids, whose ".txt" is dropped first."""
    if isinstance(ids, list):
        wanted = [i.replace(".txt", "") for i in ids]
        return catalog.select("arxiv_id", "title").where(F.col("arxiv_id").isin(wanted)) if wanted else catalog.select("arxiv_id", "title").limit(0)
    return catalog.select("arxiv_id", "title").join(ids.select(without_txt(F.col("arxiv_id")).alias("arxiv_id")), "arxiv_id", "left_semi")


def first_with_label(papers: DataFrame, label: str = "label", key: str = "doc_id") -> DataFrame:
    """label, key: the first paper with each label, as choosing a label from a list resolves it."""
    return papers.groupBy(label).agg(F.min(key).alias(key))


def create_tables(spark: SparkSession, database: str) -> None:
    """Database, catalog, import log and migrations, where they are not there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.papers ({schemas.CATALOG}, bucket int) USING parquet PARTITIONED BY (bucket)")
    for name, columns in (("import_log", schemas.IMPORT_LOG), ("schema_migrations", schemas.MIGRATIONS)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def bucket_of(arxiv_id: str | Column) -> Column:
    return F.pmod(F.xxhash64(arxiv_id), F.lit(BUCKETS)).cast("int")


def publish(spark: SparkSession, name: str, changed: Callable[[DataFrame], DataFrame], ids: DataFrame) -> list[int]:
    """Replaces the rows of the buckets that hold the ids (arxiv_id), and no others, by what changed() makes of them; the buckets.

    The new rows are worked out and written aside first: a failure before they take the place of the old ones leaves the table as
    it was, and afterwards a repeated call gives the same rows. Each bucket is moved over as a whole.
    """
    buckets = sorted(r.bucket for r in ids.where("arxiv_id is not null").select(bucket_of("arxiv_id").alias("bucket")).distinct().collect())
    if not buckets:
        return []
    rows = written(changed(spark.table(name).where(F.col("bucket").isin(buckets)).drop("bucket")), work_path(spark, "catalog"))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.withColumn("bucket", bucket_of("arxiv_id")).repartition("bucket").write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)
        spark.catalog.refreshTable(name)
    return buckets


def clean(spark: SparkSession, database: str, confirm: str) -> bool:
    """Empties the catalog and the import log (not the migrations) if confirm is exactly YES."""
    if confirm != "YES":
        return False
    for name in ("papers", "import_log"):
        spark.sql(f"TRUNCATE TABLE {database}.{name}")
    return True
