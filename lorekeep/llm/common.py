"""What the operators of this subpackage share: tables, scratch folders, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that Spark puts into one Arrow batch on its way to Python, so that very long texts do not add up.
ARROW_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir; removed as the driver ends.

    Only a local session (tests) without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and losing an executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About `rows` rows of df (all, if it has no more), chosen by a hash of the columns `by`: a filter, without a sort.

    by: columns that tell rows apart, so that copies do not come or stay away together.
    """
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 31)) < F.lit(int(rows / n * (1 << 31))))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder before the driver ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns of these names renamed, so that an operator's results do not replace them; and what gives its rows
    the columns of df back, in their order, and no others."""
    clashing = {c: free_name(df, f"{c}_aside") for c in df.columns if c.lower() in {n.lower() for n in names}}
    now = {c: clashing.get(c, c) for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in now.items()]), lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in now.items()])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator is about to add: its own results replace columns of the same name."""
    added = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])


def add_by_batch(df: DataFrame, inputs: list[str], fields: list[T.StructField], work: Callable[[], Callable], size: int = ARROW_BATCH_BYTES) -> DataFrame:
    """Adds columns that Python computes from whole Arrow batches.

    work() runs once in a task and returns f(*input arrays) -> one list or array per field. Columns of df with the
    names of the new fields are replaced; all others pass through untouched. size: bytes of a batch, about.
    """
    import pyarrow as pa

    bound_batches(df.sparkSession, size)
    kept = without(df, [f.name for f in fields])
    carried = [c for c in kept.columns]
    schema = T.StructType([*kept.schema.fields, *fields])
    sent = kept
    missing = [c for c in inputs if c not in carried]
    if missing:  # an input that a result replaces still has to be sent
        sent = df.select(*[F.col(f"`{c}`") for c in [*carried, *missing]])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for b in batches:
            got = f(*[b.column(b.schema.get_field_index(c)) for c in inputs])
            new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(got, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in carried], *new], names=[*carried, *[x.name for x in fields]])

    return sent.mapInArrow(run, schema)
