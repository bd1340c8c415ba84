"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, bound_batches, bounded_sample, stored, table


@dataclass(frozen=True)
class Settings:
    """train_rows: vectors that centroids and code books are fitted on (the index holds every vector); lists grow with the
    square root of the rows up to max_lists; aim: share of the true neighbours within the training rows whose lists a query
    must visit, from which the number of visited lists is measured; probed: lists to visit, 0 for the measured number;
    parts: code bytes of a vector; refined: different vectors of a bin that get exact distances first; whatever of the visited
    lists their codes do not rule out then gets them too; members, queries: vectors of a bin of lists (fewer, if they are
    long) and queries of a block, which one task compares. With probed = max_lists the search is exact."""

    train_rows: int = 20_000
    max_lists: int = 1024
    aim: float = 0.985
    probed: int = 0
    parts: int = 16
    refined: int = 250
    members: int = 16_384
    queries: int = 1_024
    rounds: int = 8


#: Bytes of a bin's vectors in double precision, at most.
BIN_BYTES = 32 << 20
#: Tasks of the scan at most; each then takes several pairs of a bin and a block of queries.
MOST_TASKS = 20_000


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids from k different rows of x; an empty cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        near, far = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[lo : lo + 4096] @ c.T
        best[lo : lo + 4096] = d.argmin(1)
        dist[lo : lo + 4096] = d.min(1) + (x[lo : lo + 4096] ** 2).sum(1)
    return best, dist


class Quantizer:
    """Coarse centroids and a code book for each part of the residuals; its size depends on the settings alone."""

    def __init__(self, sample: np.ndarray, rows: int, s: Settings):
        self.dim = sample.shape[1]
        self.lists = kmeans(sample, int(min(s.max_lists, max(1, rows**0.5), len(sample))), s.rounds)
        near, _ = nearest(sample, self.lists)
        rest = sample - self.lists[near]
        self.cuts = np.linspace(0, self.dim, min(s.parts, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], 256, s.rounds) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probed = len(self.lists)
        self.probed = min(s.probed, len(self.lists)) or self._measured(sample, near, s.aim)

    def _measured(self, sample: np.ndarray, near: np.ndarray, aim: float, k: int = 10, tests: int = 400) -> int:
        """Lists to visit so that they hold `aim` of the k nearest training rows of some training rows. Of all rows, a query's
        nearest lie nearer than of the training rows alone, so their lists come no later."""
        at = np.arange(0, len(sample), max(1, len(sample) // tests))
        close = sample[at] @ sample.T
        close[np.arange(len(at)), at] = -np.inf
        best = np.argpartition(-close, min(k, len(sample) - 1), axis=1)[:, :k]
        place = np.argsort(self.probe(sample[at]), axis=1)
        return int(np.quantile(np.take_along_axis(place, near[best], axis=1), aim)) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and how far each vector lies from what these stand for: a product with a unit vector is off by that much
        at most."""
        near, _ = nearest(x, self.lists)
        rest = x - self.lists[near]
        codes = [nearest(rest[:, a:b], book)[0] for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        for a, b, book, code in zip(self.cuts[:-1], self.cuts[1:], self.books, codes, strict=True):
            rest[:, a:b] -= book[code]
        return near, np.stack(codes, 1).astype(np.uint8), np.sqrt((rest * rest).sum(1))

    def probe(self, q: np.ndarray) -> np.ndarray:
        """The nearest lists of each query."""
        return np.argsort(-(2 * q @ self.lists.T - (self.lists**2).sum(1)), axis=1, kind="stable")[:, : self.probed]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of the query's parts with every entry of the code books: parts x 256."""
        out = np.zeros((len(self.books), 256))
        for i, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[i, : len(book)] = book @ q[a:b]
        return out


def unit_rows(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the column that take part, these as unit vectors): not null, not zero, all components finite, `dim` long."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.list_(pa.float64()))
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    n = np.nan_to_num(np.asarray(n, np.float64), nan=-1).astype(np.int64)
    if dim is None:
        dim = int(np.bincount(n[n > 0]).argmax()) if (n > 0).any() else 1
    at = np.flatnonzero(n == dim)
    x = np.array(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        # components so small or large that their squares leave the range of doubles
        odd = np.isfinite(x).all(1) & (~np.isfinite(norm) | (norm < 1e-100)) & (x != 0).any(1)
        x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
    return at[good], x[good] / norm[good, None]


def usable(rows: DataFrame) -> DataFrame:
    """Those rows (id, v) whose vectors take part: of the commonest length of all that are finite and not zero (the shorter
    one in a tie)."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == lengths.n) if lengths else good.limit(0)


def fit(vectors: DataFrame, s: Settings) -> Quantizer | None:
    """Fits on about s.train_rows vectors, chosen by a hash of ids and vectors; None if there is no vector."""
    rows = vectors.count()
    sample = bounded_sample(vectors, s.train_rows, "id", "v").select("v").toArrow().column("v").combine_chunks()
    _, x = unit_rows(sample)
    return Quantizer(x, rows, s) if len(x) else None


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """The k nearest vectors found for each query, itself left out: query_id, rank (from 1), vec_id, score.

    queries: rows of the same columns. score is the cosine of the original vectors in double precision; ties go to the
    smaller vec_id. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows with a null key; if none is left, there are no rows. A query with fewer than k candidates gets all
    that were found. Rows with one key count as one candidate (the best of them). Equal vectors are one entry of the index,
    with the k + 1 smallest of their keys: no other of them can be among a query's k nearest.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")))
    # the limit is applied within a partition before the shuffle, so that a vector that many rows share does not gather
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    copies = stored(rows.withColumn("r", place).where(F.col("r") <= k + 1).distinct().withColumn("entry", F.min("id").over(Window.partitionBy("v"))), "vectors")
    all_rows = copies.where("r = 1").select("id", "v")
    out_schema = "query_id long, rank int, vec_id long, score double"
    quantizer = fit(all_rows, s)
    if quantizer is None:
        return spark.createDataFrame([], out_schema)
    shared = spark.sparkContext.broadcast(quantizer)

    def index():
        def run(column):
            q = shared.value
            at, x = unit_rows(column, q.dim)
            lists, codes, off = np.full(len(column), -1), [None] * len(column), np.zeros(len(column))
            if len(at):
                lists[at], c, off[at] = q.encode(x)
                for i, code in zip(at.tolist(), c, strict=True):
                    codes[i] = code.tobytes()
            return lists, codes, off

        return run

    def probes():
        def run(column):
            q = shared.value
            at, x = unit_rows(column, q.dim)
            lists, homes, units = [None] * len(column), [None] * len(column), [None] * len(column)
            for i, probed, u in zip(at.tolist(), q.probe(x), x, strict=True):
                lists[i], units[i] = probed.astype(np.int32).tobytes(), u.tobytes()
                homes[i] = sorted({b + k for j in probed.tolist() if j in shared_bins.value for b, n in [shared_bins.value[j]] for k in range(n)})
            return lists, homes, units

        return run

    list_field, code_field = T.StructField("list", T.IntegerType(), True), T.StructField("code", T.BinaryType(), True)
    off_field = T.StructField("off", T.DoubleType(), True)
    # an id may stand for several vectors, so entries are told apart by a hash of theirs
    entries = all_rows.select("id", F.xxhash64("v").alias("h"), "v")
    members = stored(add_by_batch(entries, ["v"], [list_field, code_field, off_field], index).where("list >= 0").select("id", "h", "list", "code", "off", "v"), "ivf")
    # a row for each list, of which there are max_lists at most
    bins = _bins({r.list: r.n for r in members.groupBy("list").agg(F.count("*").alias("n")).collect()}, quantizer, min(s.members, max(1, BIN_BYTES // (8 * quantizer.dim))))
    places = F.broadcast(spark.createDataFrame([(i, b, n) for i, (b, n) in bins.items()], "list int, first int, parts int"))
    members = members.join(places, "list").select("id", "h", "list", "code", "off", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("bin"))
    shared_bins = spark.sparkContext.broadcast(bins)
    asked = usable(queries.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))).where(F.size("v") == quantizer.dim)
    asked = stored(asked.dropDuplicates(["id"]), "queries")
    probed = stored(add_by_batch(asked, ["v"], [T.StructField("probed", T.BinaryType()), T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("unit", T.BinaryType())], probes).where("unit is not null").select("id", "probed", "bins", "unit", "v"), "probes")
    visits = probed.select("id", "probed", "unit", "v", F.explode("bins").alias("bin"))
    # a bin's members are copied once for each block of its own visitors
    blocks = stored(visits.groupBy("bin").agg(F.ceil(F.count("*") / s.queries).cast("int").alias("blocks")), "blocks")
    pairs = min(MOST_TASKS, max(1, blocks.agg(F.sum("blocks").alias("n")).first().n or 0))
    left = members.join(blocks, "bin").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = visits.join(blocks, "bin").withColumn("q", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")

    def scan(rows, questions):
        import pyarrow as pa

        out_q, out_id, out_h, out_s = [], [], [], []
        if rows.num_rows and questions.num_rows:
            q = shared.value
            order = np.lexsort((rows.column("h").to_numpy(), rows.column("id").to_numpy()))
            ids, hashes, lists, off = (rows.column(c).to_numpy()[order] for c in ("id", "h", "list", "off"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            x = _matrix(rows.column("v"), q.dim)[order]
            units = _matrix(rows.column("v"), q.dim, unit=True)[order]
            rough = units.astype(np.float32)
            asked = _matrix(questions.column("v"), q.dim)
            for n, (qid, probed, unit) in enumerate(zip(*(questions.column(c).to_pylist() for c in ("id", "probed", "unit")), strict=True)):
                u, visited = np.frombuffer(unit, np.float64), np.zeros(len(q.lists), bool)
                visited[np.frombuffer(probed, np.int32)] = True
                at = np.flatnonzero(visited[lists])
                t, score = q.tables(u), (q.lists @ u)[lists[at]]
                for i in range(codes.shape[1]):
                    score += t[i][codes[at, i]]
                first = at[_top(score, min(s.refined, len(at)))]
                least = _least(ids[first], units[first] @ u, k + 1)
                # those whose codes allow for more; first by single, then by double precision
                left = at[score + off[at] >= least - 1e-6]
                near = rough[left] @ u.astype(np.float32) if 2 * len(left) < len(ids) else (rough @ u.astype(np.float32))[left]
                left = left[near >= least - 1e-6 * (q.dim + 10)]
                near = units[left] @ u
                left = left[near >= _least(ids[left], near, k + 1) - 1e-9]
                near = cosines(x[left], asked[n])
                best = np.lexsort((hashes[left], ids[left], -near))
                _, new = np.unique(ids[left[best]], return_index=True)
                best = best[: np.sort(new)[k] + 1 if len(new) > k else None]
                out_q.append(np.full(len(best), qid))
                out_id.append(ids[left[best]])
                out_h.append(hashes[left[best]])
                out_s.append(near[best])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query_id": np.concatenate(out_q or empty), "entry": np.concatenate(out_id or empty), "h": np.concatenate(out_h or empty), "score": np.concatenate(out_s or [np.zeros(0)])})

    scored = left.repartition(pairs, "bin", "q").groupBy("bin", "q").cogroup(right.repartition(pairs, "bin", "q").groupBy("bin", "q")).applyInArrow(scan, "query_id long, entry long, h long, score double")
    keys = copies.select("entry", F.xxhash64("v").alias("h"), "id")
    scored = scored.join(keys, ["entry", "h"]).where("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _bins(sizes: dict[int, int], q: Quantizer, most: int) -> dict[int, tuple[int, int]]:
    """list -> (first bin, number of bins). Lists near each other share bins of about `most` vectors; a longer list gets
    bins of its own, over which its vectors are spread."""
    along = q.lists @ np.linalg.eigh(np.cov(q.lists.T) if len(q.lists) > 1 else np.eye(q.dim))[1][:, -1]
    out, bin_, load = {}, 0, 0
    for i in sorted(sizes, key=lambda i: (along[i], i)):
        if load and load + sizes[i] > most:
            bin_, load = bin_ + 1, 0
        parts = max(1, -(-sizes[i] // most))
        out[i] = (bin_, parts)
        load += sizes[i]
        if parts > 1:
            bin_, load = bin_ + parts, 0
    return out


def _matrix(column, dim: int, unit: bool = False) -> np.ndarray:
    """Rows of a column of vectors that all take part, as they are or as unit vectors."""
    import pyarrow as pa

    column = column.combine_chunks().cast(pa.list_(pa.float64()))
    return unit_rows(column, dim)[1] if unit else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with y. Rows whose squares leave the range of doubles are scaled first."""
    with np.errstate(all="ignore"):
        score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum()))
        odd = np.flatnonzero(~np.isfinite(score))
        if len(odd):
            a, b = x[odd] / np.abs(x[odd]).max(1, keepdims=True), y / np.abs(y).max()
            score[odd] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum()))
    return score


def _least(ids: np.ndarray, score: np.ndarray, k: int) -> float:
    """The score of the k-th best of different ids; minus infinity if there are fewer."""
    order = np.argsort(-score, kind="stable")
    _, new = np.unique(ids[order], return_index=True)
    return float(score[order[np.sort(new)[k - 1]]]) if len(new) >= k else float("-inf")


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores, by falling score; the first ones among equals."""
    if not k:
        return np.zeros(0, np.int64)
    least = -np.partition(-score, k - 1)[k - 1]
    above = np.flatnonzero(score > least)
    level = np.flatnonzero(score == least)[: k - len(above)]
    best = np.concatenate([above, level])
    return best[np.lexsort((best, -score[best]))]


def op3_query(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"), k=5)
