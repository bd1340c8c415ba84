"""The engine as one object: upload, search, import, answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Settings
from .functions import segment
from .functions.embed import LearnedEmbedder, embedded
from .functions.text import TOKEN, TOKEN_ANY, is_modern_id
from .operators import bm25, catalog, context, embedding, hybrid, importer, knn, segmentation
from .operators.chunking import with_metadata
from .operators.index import FILTER_TERMS, Index
from .session import work_path, written
from .sources import files, papers, pdf
from .streaming.ingest import chunk_rows


class Engine:
    """Tables in a database, an index in a folder. embedder, completer, parser and fetch are plain functions over batches."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Callable | None = None, completer: Callable = context.extractive, parser: Callable = pdf.pdf_pages, fetch: Callable[[str], bytes] | None = None):
        self.spark, self.settings = spark, settings or Settings.load()
        self.completer, self.parser, self.fetch = completer, parser, fetch
        self.embedder = embedder or embedding.load(spark, f"{self.settings.index_dir}/embedder")
        self.index = Index(spark, self.settings.index_dir, self.embedder, self.settings.embedding_dim, self._tokenizer())
        catalog.create_tables(spark, self.settings.database)

    def _tokenizer(self):
        """The pattern of settings.tokens; for "words", the segmenter that lies beside the index (before fit_segmenter(), one that
        takes every Chinese character for a word)."""
        if self.settings.tokens == "words":
            return segment.tokenizer(segmentation.load(self.spark, f"{self.settings.index_dir}/lexicon") or segment.Lexicon.of({}))
        return {"ascii": TOKEN, "any": TOKEN_ANY}[self.settings.tokens]

    def fit_segmenter(self, texts: DataFrame, text: str = "text", learning: segmentation.Learning | None = None) -> segment.Lexicon:
        """Learns to segment from a corpus, and keeps the lexicon beside the index. The index has to be empty: postings of different
        segmentations do not meet."""
        if self.index.batches():
            raise ValueError("the index holds documents that are segmented already")
        lexicon = segmentation.learn(texts, text, learning)
        segmentation.save(self.spark, lexicon, f"{self.settings.index_dir}/lexicon")
        self.index.pattern = self._tokenizer()
        return lexicon

    def fit_embedder(self, texts: DataFrame, text: str = "text", learning: embedding.Learning | None = None) -> LearnedEmbedder:
        """Learns vectors of words from a corpus, and keeps them beside the index, for every engine that opens it without an
        embedder of its own. The index has to be empty: vectors of different embedders do not meet."""
        if self.index.batches():
            raise ValueError("the index holds vectors already")
        learned = embedding.learn(texts, text, learning or embedding.Learning(dim=self.settings.embedding_dim))
        embedding.save(self.spark, learned, f"{self.settings.index_dir}/embedder")
        self.embedder = self.index.embedder = learned
        return learned

    def _table(self, name: str) -> str:
        return f"{self.settings.database}.{name}"

    def upload(self, path: str, metadata: dict[str, str] | None = None, dedup: bool = False) -> int:
        """Chunks of all .pdf and .txt files at a path, added to the index; their number."""
        pages = with_metadata(files.load_files(self.spark, path, self.parser), metadata).where("page_content is not null")
        return self.index.add(chunk_rows(pages, self.settings.chunk_size, self.settings.chunk_overlap), dedup)

    def search_papers(self, query: str, max_results: int = 10, found: DataFrame | None = None) -> DataFrame:
        """Remote results as shown to users; found: search results at hand instead."""
        s = self.settings
        got = found if found is not None else papers.search_remote(self.spark, query, s.api_base, max_results, page=s.search_page, delay=s.search_delay_s, retries=s.search_retries)
        return papers.search_view(got.orderBy("relevance").limit(max_results))

    def search_category(self, category: str, limit: int = 50, year: int | None = None) -> DataFrame:
        s = self.settings
        return papers.search_remote(self.spark, papers.query_for(category, year), s.api_base, limit, page=s.search_page, delay=s.search_delay_s, retries=s.search_retries)

    def search_response(self, query: str, max_results: int = 10, found: DataFrame | None = None) -> tuple[DataFrame, int]:
        """The results of a search, and their number."""
        shown = written(self.search_papers(query, max_results, found), work_path(self.spark, "search"))
        return shown, shown.count()

    def _kept(self, folder: str, schema: str) -> DataFrame | None:
        """The table of what earlier imports wrote to a folder, and the file that each row lies in; None before the first."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder).withColumn("file_", F.col("_metadata.file_path"))

    def _only(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows with an id that is wanted; up to FILTER_TERMS ids go to the scan as a filter, so that files and row groups without
        them are not read."""
        ids = [r.arxiv_id for r in wanted.select("arxiv_id").distinct().limit(FILTER_TERMS + 1).collect()]
        return rows.where(F.col("arxiv_id").isin(ids)) if len(ids) <= FILTER_TERMS else rows.join(wanted.select("arxiv_id").distinct(), "arxiv_id", "left_semi")

    def _downloaded(self, wanted: DataFrame, batch: str) -> DataFrame:
        """arxiv_id, content, pdf_path. A download that is there and large enough to be whole is not fetched again; lengths are
        columns of their own, so contents are read of wanted papers alone."""
        s, schema = self.settings, "arxiv_id string, title string, file string, content binary, length long"
        have = self._kept(s.pdf_dir, schema)
        missing = wanted if have is None else wanted.join(self._only(have.where(F.col("length") > files.LEAST_BYTES).select("arxiv_id"), wanted), "arxiv_id", "left_anti")
        if self.fetch:
            fetched = papers.download(missing, self.fetch).where("content is not null").withColumn("length", F.octet_length("content").cast("long"))
            fetched.sortWithinPartitions("arxiv_id").write.parquet(f"{s.pdf_dir}/{batch}")
        got = self._kept(s.pdf_dir, schema)
        if got is None:
            return wanted.select("arxiv_id", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("pdf_path")).limit(0)
        return self._only(got.select("arxiv_id", "content", F.col("file_").alias("pdf_path")), wanted).dropDuplicates(["arxiv_id"])

    def import_papers(self, wanted: DataFrame, category: str = "manual", downloaded: DataFrame | None = None) -> DataFrame:
        """schemas.IMPORT_RESULT for every paper (arxiv_id and any other columns of schemas.PAPER_INFO): download, parse, upsert,
        chunk, index, mark, log. Of rows with one id, one is imported.

        downloaded: arxiv_id, content of papers at hand; otherwise what is kept below pdf_dir, and the engine's fetch
        function for the rest. Texts are written below text_dir where an id has none yet; paths in the catalog name the
        files that hold them. `wanted` (a remote search, perhaps) is evaluated once.
        """
        s, batch = self.settings, f"batch-{uuid.uuid4().hex}"
        known = dict(part.split(" ", 1) for part in schemas.PAPER_INFO.split(", "))
        full = wanted.select(*[F.col(c).cast(t).alias(c) if c in wanted.columns else F.lit(None).cast(t).alias(c) for c, t in known.items()])
        wanted = written(full.where("arxiv_id is not null").dropDuplicates(["arxiv_id"]), work_path(self.spark, "wanted"))
        got = self._downloaded(wanted, batch) if downloaded is None else downloaded.select("arxiv_id", "content", F.lit(None).cast("string").alias("pdf_path"))
        parsed = files.pdf_text(files.pdf_pages(got.where("content is not null").select(F.col("arxiv_id").alias("path"), "content"), self.parser))
        parsed = written(parsed.withColumnRenamed("path", "arxiv_id"), work_path(self.spark, "parsed"))
        schema = "arxiv_id string, text string"
        fresh, have = parsed.where("error is null").select("arxiv_id", "text"), self._kept(s.text_dir, schema)
        (fresh if have is None else fresh.join(self._only(have.select("arxiv_id"), wanted), "arxiv_id", "left_anti")).sortWithinPartitions("arxiv_id").write.parquet(f"{s.text_dir}/{batch}")
        texts = self._only(self._kept(s.text_dir, schema), wanted).dropDuplicates(["arxiv_id"]).select("arxiv_id", "text", F.col("file_").alias("txt_path"))
        ready = wanted.join(parsed.where("error is null").select("arxiv_id"), "arxiv_id", "left_semi").join(texts, "arxiv_id").join(got.select("arxiv_id", "pdf_path").dropDuplicates(["arxiv_id"]), "arxiv_id", "left")
        ready = written(ready, work_path(self.spark, "ready"))
        payload = importer.payload(ready, category)
        catalog.publish(self.spark, self._table("papers"), lambda known: catalog.upsert(known, payload), ready)
        source = F.concat("arxiv_id", F.lit(".txt"))
        pages = ready.select(source.alias("source"), F.lit(0).alias("page"), F.col("text").alias("page_content"), F.create_map(F.lit("arxiv_id"), "arxiv_id", F.lit("title"), "title", F.lit("category"), F.lit(category), F.lit("source"), source).alias("metadata"))
        self.index.add(chunk_rows(pages, s.chunk_size, s.chunk_overlap), batch=batch)
        catalog.publish(self.spark, self._table("papers"), lambda known: catalog.mark_vectorized(known, ready.select("arxiv_id")), ready)
        counts = self.index.read("chunks", batch).groupBy("arxiv_id").agg(F.count("*").cast("int").alias("n"))
        joined = wanted.select("arxiv_id", "title").join(parsed.select("arxiv_id", "error", F.lit(True).alias("came")), "arxiv_id", "left").join(counts, "arxiv_id", "left")
        ok = F.col("came").isNotNull() & F.col("error").isNull()
        results = joined.select("arxiv_id", "title", ok.alias("success"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("chunks"), F.when(F.col("came").isNull(), "下载失败").otherwise(F.col("error")).alias("error"))
        results = written(results, work_path(self.spark, "results"))
        log = results.select("arxiv_id", F.lit(category).alias("category"), F.when(F.col("success"), "success").otherwise("error").alias("status"), "error", F.current_timestamp().alias("created_at"))
        log.write.insertInto(self._table("import_log"))
        return results

    def import_category(self, category: str, target: int = 100, year: int | None = None, found: DataFrame | None = None, downloaded: DataFrame | None = None) -> DataFrame:
        chosen = importer.search(found, category, year, target) if found is not None else self.search_category(category, target, year)
        return self.import_papers(chosen, category, downloaded)

    def _by_quota(self, category: str, target: int, years: range, batch: int) -> DataFrame:
        """Papers of a category, year by year from the remote, until the target is reached; at most years x batch rows."""
        got: list = []
        for year in years:
            if len(got) >= target:
                break
            got += self.search_category(category, min(batch, target - len(got)), year).where(is_modern_id(F.col("arxiv_id"))).select(*[c.split(" ")[0] for c in schemas.PAPER_INFO.split(", ")]).collect()
        return self.spark.createDataFrame(got[:target], schemas.PAPER_INFO)

    def import_quotas(self, targets: dict[str, int] | None = None, found: DataFrame | None = None, downloaded: DataFrame | None = None, start: int = 2026, end: int = 2000, batch: int = 50) -> DataFrame:
        """category, and import results, for the papers that the categories' targets take (schemas.QUOTAS). A category that fails
        gives one row with the error, and the others go on. found: papers at hand (with relevance), instead of the remote."""
        results = self.spark.createDataFrame([], f"category string, {schemas.IMPORT_RESULT}")
        for category, target in (targets or schemas.QUOTAS).items():
            try:
                if found is None:
                    chosen = self._by_quota(category, target, range(start, end - 1, -1), batch)
                else:
                    chosen = found.join(importer.quota(found, self.spark.createDataFrame([(category, target)], "category string, target int"), start, end, batch).select("arxiv_id"), "arxiv_id", "left_semi")
                got = self.import_papers(chosen, category, downloaded).select(F.lit(category).alias("category"), "*")
            except Exception as e:  # noqa: BLE001  a category's failure is its result
                got = self.spark.createDataFrame([(category, None, None, False, 0, f"{type(e).__name__}: {e}"[:500])], results.schema)
            results = results.unionByName(got)
        return results

    def clean(self, confirm: str) -> bool:
        """Removes the index, downloads and texts, and empties catalog and import log, if confirm is exactly YES."""
        if not self.index.clear(confirm):
            return False
        for folder in (self.settings.pdf_dir, self.settings.text_dir):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return catalog.clean(self.spark, self.settings.database, confirm)

    def hybrid_search(self, questions: DataFrame, k: int | None = None, vector_weight: float | None = None, bm25_weight: float | None = None) -> DataFrame:
        """qid, rank, text, score, arxiv_id of the best chunks for each question (qid, question)."""
        s = self.settings
        k = k or s.retrieval_k
        asked = questions.select("qid", embedded(F.col("question"), self.embedder, s.embedding_dim).alias("q"))
        near = knn.nearest_batch(self.index.read("vectors"), asked, 2 * k, "id", "embedding")
        scores = self.index.top(bm25.query_terms(questions, "qid", "question", self.index.pattern), 2 * k)
        legs = hybrid.vector_leg(near, s.vector_weight if vector_weight is None else vector_weight, s.distance_cutoff), hybrid.bm25_leg(scores, k, s.bm25_weight if bm25_weight is None else bm25_weight)
        # 4k hits a question at most; their chunks are read once, with what is shown of them
        hits = written(legs[0].unionByName(legs[1]), work_path(self.spark, "hits"))
        chunks = written(self.index.chunks_of(hits).select("chunk_id", "page_content", "arxiv_id", "source"), work_path(self.spark, "chunks"))
        best = hybrid.fuse(chunks, hits, None, k, "chunk_id", "page_content")
        return best.join(chunks.select(F.col("chunk_id").alias("id"), "arxiv_id", "source"), "id")

    def answer(self, questions: DataFrame) -> DataFrame:
        """qid, question, answer for questions (qid, question, history array<struct<u, a>>)."""
        hits = written(self.hybrid_search(questions), work_path(self.spark, "hits"))
        return context.answers(questions, hits, self.spark.table(self._table("papers")), self.completer, self.settings.history_pairs)

    def quotas(self) -> DataFrame:
        return self.spark.createDataFrame(list(schemas.QUOTAS.items()), "category string, target int")


def last_turns(turns: DataFrame, last: int = 5) -> DataFrame:
    """conv_id, history of a table of turns, as answer() takes it."""
    pairs = context.history_pairs(turns, last)
    return pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "user", "assistant"))), lambda p: F.struct(p["user"].alias("u"), p["assistant"].alias("a"))).alias("history"))


__all__ = ["Engine", "Settings", "last_turns"]
