"""Learning an embedder: words that occur near each other, their positive pointwise mutual information, and its largest singular
directions by a randomised decomposition. The matrix stays distributed; what the driver holds is a thin block of vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import LearnedEmbedder, split_words
from ..session import work_path, written
from .segmentation import most_frequent

#: Entries of a task's sums before it hands them on.
HELD = 1_000_000


@dataclass(frozen=True)
class Learning:
    """dim: of the vectors; words: the most frequent ones that are learned, at most; least: occurrences of a word; window: words to
    either side that count as near; extra, passes: more directions, and passes over the matrix, that make the decomposition
    exact enough; smooth: share of all words at which a word weighs half."""

    dim: int = 64
    words: int = 20_000
    least: int = 3
    window: int = 4
    extra: int = 10
    passes: int = 2
    smooth: float = 1e-3


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                own.update(split_words(t) if isinstance(t, str) else ())
                if len(own) > HELD:
                    yield pd.DataFrame(own.items(), columns=["word", "n"])
                    own = Counter()
        yield pd.DataFrame(own.items(), columns=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_counts(docs: DataFrame, words: list[str], window: int, text: str = "text") -> DataFrame:
    """i, j, n: how often two words of the list stand within a window of each other, both ways round. Sums of a batch are made
    where it is; other words keep their places."""
    shared, size = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)}), max(1, len(words))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value
        keys, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"i": keys // size, "j": keys % size, "n": ns})

        for b in batches:
            ids: list[int] = []
            for t in b["text"]:
                ids += [places.get(w, -1) for w in split_words(t)] if isinstance(t, str) else []
                ids += [-1] * window  # nothing is near across texts
            x = np.array(ids, np.int64)
            found = []
            for d in range(1, window + 1):
                a, c = x[:-d], x[d:]
                good = (a >= 0) & (c >= 0)
                found += [a[good] * size + c[good], c[good] * size + a[good]]
            new, n = np.unique(np.concatenate(found), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            ns = np.bincount(place, np.concatenate([ns, n]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield rows()
                keys, ns = keys[:0], ns[:0]
        yield rows()

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


class Associations:
    """The symmetric matrix of max(0, log(n total / (n_i n_j))), as rows (i, j, n) of a stored table."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size
        self.sums = np.zeros(size)
        for r in rows.groupBy("i").agg(F.sum("n").alias("n")).collect():  # one number a word
            self.sums[r.i] = r.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """The matrix times a thin block (size, k). Rows of one word lie together, so a task hands on about one sum for each."""
        import pyarrow as pa

        k = block.shape[1]
        shared = self.rows.sparkSession.sparkContext.broadcast((block, np.log(np.maximum(self.sums, 1)), np.log(max(1.0, self.sums.sum()))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, logs, total = shared.value
            for b in batches:
                i, j, n = (c.to_numpy() for c in b.columns)
                if not len(i):
                    continue
                x = np.maximum(0, np.log(n) + total - logs[i] - logs[j])
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                sums = np.add.reduceat(x[:, None] * own[j], starts, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), k).cast(pa.list_(pa.float64()))], names=["i", "v"])

        got = self.rows.select("i", "j", "n").mapInArrow(run, "i long, v array<double>").toArrow()
        out = np.zeros((self.size, k))
        if len(got):
            np.add.at(out, got.column("i").to_numpy(), got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, k))
        return out

    def leading(self, dim: int, extra: int, passes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """The left singular vectors of the largest singular values, and these: a random block, multiplied and made orthogonal
        again some times (Halko, Martinsson, Tropp 2011)."""
        k = min(self.size, dim + extra)
        q, _ = np.linalg.qr(self.times(np.random.default_rng(seed).normal(size=(self.size, k))))
        for _ in range(passes):
            q, _ = np.linalg.qr(self.times(q))
        u, s, _ = np.linalg.svd(self.times(q).T, full_matrices=False)  # the matrix is symmetric
        return (q @ u)[:, :dim], s[:dim]


def learn(docs: DataFrame, text: str = "text", learning: Learning | None = None) -> LearnedEmbedder:
    """An embedder from all texts of a corpus. Null and empty texts tell nothing; without a word that is frequent enough every text
    gets the zero vector. The driver holds learning.words vectors."""
    s, spark = learning or Learning(), docs.sparkSession
    counts = written(word_counts(docs, text), work_path(spark, "word-counts"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = sorted(((-r.n, r.word) for r in most_frequent(counts.where(F.col("n") >= s.least), s.words).collect()))
    words = [w for _, w in kept]
    if not words:
        return LearnedEmbedder([], np.zeros((0, s.dim)), np.zeros(0), np.zeros(s.dim))
    rows = near_counts(docs, words, s.window, text).repartition("i").sortWithinPartitions("i", "j")
    matrix = Associations(written(rows, work_path(spark, "near")), len(words))
    u, values = matrix.leading(s.dim, s.extra, s.passes)
    vectors = np.zeros((len(words), s.dim))
    vectors[:, : u.shape[1]] = u * np.sqrt(values)
    share = np.array([-n for n, _ in kept]) / total
    plain = LearnedEmbedder(words, vectors, s.smooth / (s.smooth + share), np.zeros(s.dim))
    return LearnedEmbedder(words, vectors, plain.weights, common_direction(docs, plain, text))


def common_direction(docs: DataFrame, embedder: LearnedEmbedder, text: str = "text") -> np.ndarray:
    """The direction that the vectors of all texts share most: each task adds up a square of the vectors' width."""
    shared, dim = docs.sparkSession.sparkContext.broadcast(embedder), embedder.vectors.shape[1]

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((dim, dim))
        for b in batches:
            v = shared.value.means(b["text"].fillna("").tolist()).astype(float)
            own += v.T @ v
        yield pd.DataFrame({"k": np.arange(dim * dim), "x": own.ravel()})

    got = docs.select(F.col(text).alias("text")).mapInPandas(squares, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    square = np.zeros(dim * dim)
    square[got.column("k").to_numpy()] = got.column("x").to_numpy()
    values, vectors = np.linalg.eigh(square.reshape(dim, dim))
    return vectors[:, -1] if values[-1] > 0 else np.zeros(dim)


def save(spark: SparkSession, embedder: LearnedEmbedder, path: str) -> None:
    """A row for each word, in order, and one without a word for the common direction."""
    rows = [(i, w, float(embedder.weights[i]), embedder.vectors[i].tolist()) for w, i in embedder.places.items()]
    spark.createDataFrame([*rows, (-1, None, 0.0, embedder.common.tolist())], "place int, word string, weight float, vector array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> LearnedEmbedder | None:
    """What save() wrote; None if there is nothing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.place)
    dim = len(rows[0].vector)
    return LearnedEmbedder([r.word for r in rows[1:]], np.array([r.vector for r in rows[1:]]).reshape(-1, dim), np.array([r.weight for r in rows[1:]]), np.array(rows[0].vector))
