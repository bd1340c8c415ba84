"""Nearest neighbours by squared Euclidean distance: an exact scan, and Spark ML's hashing for approximate answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def nearest(vectors: DataFrame, query: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, d2 of the k vectors nearest to one query (a single row with a column q), nearest first, ties by id.

    One pass over the vectors with the query row sent to each task; every task hands on k rows at most.
    """
    d2 = vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select(F.col(id).alias("id"), squared_distance(F.col(vector), F.col("q")).alias("d2"))
    return d2.where(F.col("d2").isNotNull() & ~F.isnan("d2")).orderBy("d2", "id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", block: int = 20_000) -> DataFrame:
    """qid, id, d2, rk for a stated list of queries (qid, q) against all vectors, in blocks of `block` queries.

    Queries are dealt to blocks by hash, so that a block has about `block` rows; one pass over the vectors multiplies
    Arrow batches with the block. Each task hands on k rows a query, by distances exact to the last bit but one, ties by id.
    Null vectors, those with null or NaN components and those of another length than the query take no part.
    """
    spark = queries.sparkSession
    ids = [vectors.schema[id].dataType, queries.schema["qid"].dataType]
    schema = f"qid {ids[1].simpleString()}, id {ids[0].simpleString()}, d2 double"
    blocks = -(-queries.count() // block)
    numbered = queries.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(max(1, blocks))).alias("b_"))
    out = None
    for b in range(blocks):
        rows = numbered.where(F.col("b_") == b).select("qid", "q").collect()
        own = _scan(spark.sparkContext.broadcast([(r.qid, r.q) for r in rows if r.q is not None]), k, to_arrow_type(ids[1]), to_arrow_type(ids[0]))
        found = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(own, schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))
    return out.withColumn("rk", rank).where(F.col("rk") <= k)


def _scan(shared, k: int, qid_type, id_type):
    """Passes Arrow batches (id, v) over; gives the k nearest of a task for each query."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        by_dim: dict[int, list] = {}
        for qid, q in shared.value:
            if all(x is not None for x in q):
                by_dim.setdefault(len(q), []).append((qid, q))
        best: dict = {qid: [] for qid, _ in shared.value}
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
            for dim, asked in by_dim.items():
                at = np.flatnonzero(lengths == dim)
                if not len(at) or not dim:
                    continue
                x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(x).all(axis=1)
                x, names = x[good], batch.column(0).take(pa.array(at[good])).to_pylist()
                square = (x * x).sum(axis=1)
                for lo in range(0, len(asked) if len(x) else 0, 256):
                    q = np.array([v for _, v in asked[lo : lo + 256]], np.float64)
                    near = square - 2 * q @ x.T  # less the query's own square
                    cut = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                    slack = 1e-9 * (1 + square.max() + (q * q).sum(axis=1))
                    for i, (qid, _) in enumerate(asked[lo : lo + 256]):
                        rows = np.flatnonzero(near[i] <= cut[i] + slack[i])
                        exact = ((x[rows] - q[i]) ** 2).cumsum(axis=1)[:, -1]
                        best[qid] = sorted([*best[qid], *((d, names[r]) for d, r in zip(exact.tolist(), rows.tolist(), strict=True))])[:k]
        rows = [(qid, name, d) for qid, found in best.items() for d, name in found]
        qids, names, d2 = zip(*rows, strict=True) if rows else ((), (), ())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(qids, qid_type), pa.array(names, id_type), pa.array(d2, pa.float64())], names=["qid", "id", "d2"])

    return run


def within(hits: DataFrame, cutoff: float = 1.5) -> DataFrame:
    """Hits up to the cutoff, itself included; NaN is beyond it."""
    return hits.where(~(F.col("d2") > cutoff))


def approximate(vectors: DataFrame, query: list[float], k: int, id: str = "vec_id", vector: str = "embedding", width: float = 0.8, tables: int = 8, seed: int = 11) -> DataFrame:
    """Like nearest(), but over the buckets that random projections share with the query; may miss neighbours. Of equally
    distant ones the smaller ids come first: a few more than k are fetched, as Spark ML cuts ties anywhere."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = vectors.select(F.col(id).alias("id"), F.col(vector), array_to_vector(F.col(vector)).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense(query), 2 * k + 10, distCol="d")
    return near.select("id", (F.col("d") * F.col("d")).alias("d2")).orderBy("d2", "id").limit(k)
