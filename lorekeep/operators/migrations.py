"""Versioned schema migrations: V<digits>__<name>.sql files, applied once each in order of their version text."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import statements

FILE = r"^V(\d+__\w+)\.sql$"


def files(names: DataFrame) -> DataFrame:
    """name, version of the names that are migrations. names: name."""
    return names.select("name", F.regexp_extract("name", FILE, 1).alias("version")).where("version <> ''")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, version, sql of a folder's migrations; a folder without any, or no folder, gives no rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string, version string, sql string")
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("sql"))
    return texts.select("name", F.regexp_extract("name", FILE, 1).alias("version"), "sql").where("version <> ''")


def pending(found: DataFrame, applied: DataFrame) -> DataFrame:
    return found.join(applied.select("version"), "version", "left_anti").orderBy("version")


def status(found: DataFrame, applied: DataFrame) -> DataFrame:
    """version, name, state: applied versions, then pending files."""
    done = applied.select("version", F.lit(None).cast("string").alias("name"), F.lit("applied").alias("state"))
    return done.unionByName(found.select("version", "name").join(applied, "version", "left_anti").withColumn("state", F.lit("pending"))).orderBy("state", "version")


#: What a semicolon does not end: comments, quoted text and names, bodies between dollar signs; those left open go on to the end.
_TOKEN = re.compile(r"""(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<end>;)|'(?:[^'\\]|\\.|'')*(?:'|\Z)|"(?:[^"\\]|\\.|"")*(?:"|\Z)|`(?:[^`]|``)*(?:`|\Z)|(?P<dollar>\$\w*\$).*?(?:(?P=dollar)|\Z)|[^;'"`$/\-]+|.""", re.S)


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons, stripped; what holds nothing but comments and white space is none."""
    out, own, real = [], [], False
    for m in [*_TOKEN.finditer(sql), None]:
        if m is None or m["end"]:
            if real:
                out.append("".join(own).strip())
            own, real = [], False
            continue
        own.append(m[0])
        real = real or (not m["comment"] and not m[0].isspace())
    return out


def migrate(spark: SparkSession, folder: str, table: str = "schema_migrations", naive: bool = False) -> list[str]:
    """Runs what is pending and records it; the versions applied. The folder's files are few and run one after another.

    naive: cut at every semicolon, those within literals and comments too.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (version string, applied_at timestamp) USING parquet")
    todo = pending(listing(spark, folder), spark.table(table)).select("version", "sql", statements(F.col("sql")).alias("parts")).collect()
    for row in sorted(todo, key=lambda r: r.version):
        for part in row.parts if naive else split_statements(row.sql):
            spark.sql(part)
        spark.createDataFrame([(row.version,)], "version string").withColumn("applied_at", F.current_timestamp()).write.insertInto(table)
    return sorted(r.version for r in todo)


def create(spark: SparkSession, folder: str, name: str, at: datetime | None = None) -> str:
    """Writes an empty migration named by the time; its path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/V{(at or datetime.now(UTC)).strftime('%Y%m%d%H%M%S')}__{name}.sql")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write("-- SQL statements, separated by semicolons\n".encode())
    finally:
        out.close()
    return path.toString()
