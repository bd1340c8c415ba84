"""The persisted index: chunks, vectors and blocks of postings as Parquet, appended to batch by batch; statistics derive from them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.embed import embedded
from ..functions.text import TOKEN
from . import blockmax, bm25

PARTS = ("chunks", "vectors", "blocks", "terms")
VECTORS = "id string, embedding array<float>"
TERMS = "term string, df long"
#: Terms of a batch of questions up to which they are sent to the scan of postings as a filter.
FILTER_TERMS = 1_000
#: Bytes of a row group of blocks.
ROW_GROUP = 8 << 20


def distinct_contents(rows: DataFrame, text: str = "page_content", key: str | None = None) -> DataFrame:
    """One row of each text, the one with the smallest key if there is one; with `copies`, how many there were."""
    kept = [F.min(key).alias(key)] if key else []
    return rows.groupBy(text).agg(*kept, F.count("*").alias("copies"))


class Index:
    """A folder with one table for each part. A batch of chunks is written to all parts under one name, and a batch counts
    once its marker is there, so that readers see whole batches only. Ids of chunks start with the batch's name: equal
    texts and equal files of several batches stay documents of their own."""

    def __init__(self, spark: SparkSession, path: str, embedder: Callable | None = None, dim: int = 64, pattern: str = TOKEN):
        self.spark, self.path, self.embedder, self.dim, self.pattern = spark, path.rstrip("/"), embedder, dim, pattern

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the batches that count, in order. The marker of a merged batch holds the names of those it replaces."""
        fs, marks = self._fs(), self._path("batches")
        names = {s.getPath().getName() for s in fs.listStatus(marks)} if fs.exists(marks) else set()
        merged = [n for n in names if n.endswith("-merged")]
        return sorted(names - {s.getPath().getName() for n in merged for s in fs.listStatus(self._path(f"batches/{n}"))})

    def add(self, chunks: DataFrame, dedup: bool = False, batch: str | None = None) -> int:
        """Appends chunks (schemas.CHUNKS) and returns their number; none: nothing happens. Adding a text again keeps both
        copies, unless dedup leaves out texts that the index or the batch already holds.

        batch: a name that tells a repeated attempt from a new batch: one that counts already is not added again. Without
        it the time and a random number name the batch, so that several writers do not meet.
        """
        known = self.batches()
        if batch in known:
            return 0
        name = batch or f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        if dedup:
            chunks = chunks.dropDuplicates(["page_content"])
            if known:
                chunks = chunks.join(self.read("chunks").select("page_content"), "page_content", "left_anti").select(*chunks.columns)
        # batch, source and place in it; a row number tells equal ones apart
        own = F.concat(F.lit(f"{name}/"), F.coalesce("source", F.lit("")), F.lit("#"), F.lpad(F.coalesce("chunk_index", F.lit(0)).cast("string"), 8, "0"), F.lit("#"), F.monotonically_increasing_id().cast("string"))
        self._write(chunks.withColumn("chunk_id", own), "chunks", name)
        stored = self.spark.read.schema(schemas.CHUNKS).parquet(self._part("chunks", name))
        n = stored.count()
        if not n:
            return 0
        self._write(stored.select(F.col("chunk_id").alias("id"), embedded(F.col("page_content"), self.embedder, self.dim).alias("embedding")), "vectors", name)
        # runs in order of terms and ranges, in row groups shorter than a run, so that both are found by their statistics; a term
        # that all texts have stays spread over the files
        self._write(blockmax.blocks(stored, "chunk_id", "page_content", self.pattern), "blocks", name)
        blocks = self.spark.read.schema(blockmax.BLOCKS).parquet(self._part("blocks", name))
        self._write(blocks.where("term != ''").groupBy("term").agg(F.sum("n").cast("long").alias("df")), "terms", name)
        self._fs().mkdirs(self._path(f"batches/{name}"))
        return n

    def _write(self, rows: DataFrame, part: str, batch: str) -> None:
        small = {"parquet.block.size": str(ROW_GROUP)} if part == "blocks" else {}
        rows.write.mode("overwrite").options(compression="zstd", **small).parquet(self._part(part, batch))

    def _part(self, part: str, batch: str) -> str:
        return f"{self.path}/{part}/batch={batch}"

    def merge(self) -> str | None:
        """Makes one batch of all, so that many small ones cost no listings; ids stay. Its marker appears by one renaming.
        The files of the replaced batches stay for readers that have begun; sweep() removes them."""
        old = self.batches()
        if len(old) < 2:
            return None
        name = f"{old[-1].removesuffix('-merged')}-{uuid.uuid4().hex[:6]}-merged"
        for part in PARTS:
            rows = self.read(part)
            rows = rows.groupBy("term").agg(F.sum("df").alias("df")) if part == "terms" else rows.sortWithinPartitions("term", "range") if part == "blocks" else rows
            self._write(rows, part, name)
        fs = self._fs()
        for b in old:
            fs.mkdirs(self._path(f"merging/{name}/{b}"))
        fs.rename(self._path(f"merging/{name}"), self._path(f"batches/{name}"))
        return name

    def sweep(self) -> int:
        """Removes the files of batches that a merged one replaced; how many there were."""
        fs, kept, gone = self._fs(), set(self.batches()), set()
        for m in [n for n in kept if n.endswith("-merged")]:
            for s in fs.listStatus(self._path(f"batches/{m}")):
                b = s.getPath().getName()
                for part in PARTS:
                    fs.delete(self._path(f"{part}/batch={b}"), True)
                fs.delete(self._path(f"batches/{b}"), True)
                gone.add(b)
        return len(gone)

    def read(self, part: str, batch: str | None = None) -> DataFrame:
        """A part over all whole batches, or of one; without any, an empty table. Damaged files fail loudly."""
        schema = {"chunks": schemas.CHUNKS, "vectors": VECTORS, "blocks": blockmax.BLOCKS, "terms": TERMS}[part]
        paths = [self._part(part, b) for b in self.batches() if batch in (None, b)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bm25(self) -> bm25.Bm25Index:
        """Frequencies and lengths are sums of what the batches have stored; neither texts nor postings are counted again."""
        lengths = self.read("blocks").where("term = ''").select(F.explode("dls").alias("dl"))
        corpus = bm25.corpus_stats(lengths)
        df = self.read("terms").groupBy("term").agg(F.sum("df").alias("df"))

        def postings(asked: DataFrame) -> DataFrame:
            terms = [r.term for r in asked.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
            found = self.read("blocks")
            return blockmax.postings(found.where(F.col("term").isin(["", *terms])) if len(terms) <= FILTER_TERMS else found)

        return bm25.Bm25Index(postings, bm25.term_stats(df, corpus), corpus)

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, id, s of the k best chunks by BM25 for each question (qid, term for each token), and those that tie with the last."""
        stats = self.bm25()
        return blockmax.Search(self.read("blocks"), stats.terms, stats.corpus, queries).top(k)

    def chunks_of(self, hits: DataFrame) -> DataFrame:
        """The chunks with an id of a stored table of hits (id); the scan gets up to FILTER_TERMS ids as a filter, so that it reads
        the files and row groups that may hold one."""
        ids = [r.id for r in hits.select("id").distinct().limit(FILTER_TERMS + 1).collect()]
        chunks = self.read("chunks")
        if len(ids) <= FILTER_TERMS:
            return chunks.where(F.col("chunk_id").isin(ids))
        return chunks.join(hits.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")

    def clear(self, confirm: str) -> bool:
        """Removes the index if confirm is exactly YES."""
        if confirm != "YES":
            return False
        self._fs().delete(self._path(), True)
        return True
