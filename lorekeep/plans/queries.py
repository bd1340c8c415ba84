"""The engine's queries over the driver's tables, and their SQL, by name.

Tables stand in for the engine's own: documents are chunks and (by rules below) papers, embeddings are their vectors paired
by id, benchmark items are questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions import text as T
from ..operators import bm25, catalog, chunking, context, hybrid, importer, index, knn, migrations, segmentation

QUERY = ["the", "and", "tion", "der", "the"]
K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: some with old ids, one to five authors, years 2000 to 2026 and none."""
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    old = F.concat(F.lit("hep-th/"), F.lpad(s(i), 7, "0"))
    new = F.concat(F.lpad(s(2000 + i % 100), 4, "0"), F.lit("."), F.lpad(s(i % 100000), 5, "0"))
    names = F.array(*[F.concat(F.lit(f"{a}. "), "source") for a in "ABCDE"])
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i % 7 == 0, old).otherwise(new).alias("arxiv_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.slice(names, F.lit(1), (i % 5 + 1).cast("int")).alias("authors"), F.when(i % 50 != 3, (2000 + i % 27).cast("int")).alias("year"), F.col("lang").alias("category"), F.col("text").alias("summary"), (i % 13).cast("int").alias("relevance"))


_PAPERS = """papers AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'hep-th/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') ELSE lpad(CAST(2000 + doc_id % 100 AS VARCHAR), 4, '0') || '.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS arxiv_id,
 split_part(text, chr(10), 1) AS title, ['A. ' || source, 'B. ' || source, 'C. ' || source, 'D. ' || source, 'E. ' || source][1:CAST(doc_id % 5 + 1 AS INT)] AS authors, CASE WHEN doc_id % 50 <> 3 THEN CAST(2000 + doc_id % 27 AS INT) END AS year, lang AS category, text AS summary, CAST(doc_id % 13 AS INT) AS relevance FROM documents)"""


def _index(spark: SparkSession, sf_dir: str) -> bm25.Bm25Index:
    return bm25.build(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BM25 = """tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
 dl AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS dl FROM documents),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, st),
 terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_SCORE = "sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))"


def _query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, t) for t in QUERY], "qid long, term string")


_Q = "q AS (SELECT term, count(*) AS qn FROM (VALUES " + ", ".join(f"('{t}')" for t in QUERY) + ") v(term) GROUP BY term)"


def bm25_term_stats(spark, sf_dir):
    t = _index(spark, sf_dir).terms
    return t.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def bm25_doc_len(spark, sf_dir):
    return bm25.doc_lengths(table(spark, sf_dir, "documents"))


def bm25_corpus(spark, sf_dir):
    return bm25.corpus_stats(bm25_doc_len(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, sf_dir):
    s = bm25.scores(_index(spark, sf_dir), _query(spark))
    return s.orderBy(F.desc("s"), F.desc("id")).limit(2 * K).select(F.col("id").alias("doc_id"), F.round("s", 6).alias("score"))


def _one(spark, sf_dir, vec_id=0):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def knn_l2_topk(spark, sf_dir):
    return knn.nearest(table(spark, sf_dir, "embeddings"), _one(spark, sf_dir), 2 * K).select(F.col("id").alias("vec_id"), F.round("d2", 6).alias("d2"), F.round(T.similarity(F.col("d2")), 6).alias("similarity"))


def knn_cutoff(spark, sf_dir):
    """The reference's rule, top 2k and then the cutoff: of the 20 nearest vectors of every id divisible by 20, those within it.
    Vectors within the cutoff beyond the 20th are no hits there either."""
    e = table(spark, sf_dir, "embeddings")
    near = knn.nearest_batch(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 20)
    return knn.within(near).select("qid", "id", F.round("d2", 6).alias("d2"), "rk")


def hybrid_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = knn.nearest(table(spark, sf_dir, "embeddings"), _one(spark, sf_dir), 2 * K)
    ranked = near.withColumn("qid", F.lit(0).cast("long")).withColumn("rk", F.row_number().over(_window("d2", "id")))
    best = _fused(spark, docs, hybrid.vector_leg(ranked), hybrid.bm25_leg(bm25.best(_index(spark, sf_dir), _query(spark), 2 * K), K))
    return best.select("rank", "text", F.round("score", 6).alias("score"), "vec_rank", "bm25_rank")


def _fused(spark, docs, vector, words):
    """Both legs are written first, 4k rows a question at most, so that Spark sends them to the documents instead of shuffling
    all texts."""
    from ..session import work_path, written

    hits = written(vector.unionByName(words), work_path(spark, "legs"))
    texts = docs.join(F.broadcast(hits.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return hybrid.fuse(texts, hits, None, K)


def _window(*by):
    from pyspark.sql import Window

    return Window.partitionBy("qid").orderBy(*by)


def hybrid_batch_questions(spark, sf_dir):
    """Every benchmark item as a question; its vector is that with its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "embeddings")
    items = table(spark, sf_dir, "benchmark")
    near = knn.nearest_batch(e, e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 2 * K)
    best = _fused(spark, docs, hybrid.vector_leg(near), hybrid.bm25_leg(bm25.best(_index(spark, sf_dir), bm25.query_terms(items), 2 * K), K))
    return best.select("qid", "rank", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 6).alias("score"), "vec_rank", "bm25_rank")


_HYBRID = f"""WITH {_BM25}, q AS (SELECT qid, term, count(*) AS qn FROM (%s) GROUP BY ALL),
 sc AS (SELECT qid, doc_id, {_SCORE} AS s FROM tf JOIN q USING (term) JOIN terms USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
 mx AS (SELECT qid, max(s) AS m FROM sc GROUP BY qid),
 b AS (SELECT qid, doc_id, s / CASE WHEN m > 0 THEN m ELSE 1 END AS bn, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id DESC) AS rk FROM sc JOIN mx USING (qid)),
 qv AS (%s),
 v AS (SELECT qid, vec_id AS doc_id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rk FROM (SELECT qid, vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qe[i] AS DOUBLE)) ** 2)) AS d2 FROM embeddings, qv)),
 u AS (SELECT qid, doc_id, 0.7 / (1 + d2) AS vs, NULL AS bs, rk AS vr, NULL AS br FROM v WHERE rk <= 10 AND d2 <= 1.5 UNION ALL SELECT qid, doc_id, NULL, 0.3 * bn, NULL, rk FROM b WHERE rk <= 10 AND s > 0),
 g AS (SELECT qid, text, coalesce(min(vs), 0) + coalesce(sum(bs), 0) AS score, min(vr) AS vec_rank, min(br) AS bm25_rank FROM u JOIN documents USING (doc_id) GROUP BY qid, text),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM g)"""


def _question_hits(spark, sf_dir):
    """The nearest 2k documents of every benchmark item within the cutoff, with their whole texts."""
    e, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    near = knn.within(knn.nearest_batch(e, asked, 2 * K)).select("qid", F.col("id").alias("doc_id"), F.col("rk").alias("rank"))
    # 2k rows a question
    return papers(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").join(near, "doc_id").select("qid", "rank", F.col("summary").alias("text"), "source", F.concat("arxiv_id", F.lit(".txt")).alias("arxiv_id"))


_HITS = _PAPERS + """, qv AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
 v AS (SELECT qid, vec_id AS doc_id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rk FROM (SELECT qid, vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qe[i] AS DOUBLE)) ** 2)) AS d2 FROM embeddings, qv)),
 hits AS (SELECT qid, rk AS rank, summary AS text, coalesce(SOURCE_OF_HIT, 'unknown') AS source FROM v JOIN papers USING (doc_id) JOIN documents USING (doc_id) WHERE rk <= 10 AND d2 <= 1.5),
 g AS (SELECT qid, source, min(rank) AS first, string_agg(text, chr(10) ORDER BY rank) AS text FROM hits GROUP BY qid, source)"""


def context_by_source(spark, sf_dir):
    return context.contexts(context.by_source(_question_hits(spark, sf_dir), "source")).select("qid", "context")


def ordered_sources(spark, sf_dir):
    g = context.by_source(_question_hits(spark, sf_dir), "source")
    return g.select("qid", "source", F.row_number().over(_window("first")).alias("place"))


def citations(spark, sf_dir):
    return context.citations(context.by_source(_question_hits(spark, sf_dir)), papers(spark, sf_dir).select(F.col("doc_id").alias("id"), "arxiv_id", "title"))


def history_last5(spark, sf_dir):
    return context.history_pairs(table(spark, sf_dir, "conversations"), 5)


_HISTORY = """spoken AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 back AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM spoken WHERE role = 'user' AND reply_role = 'assistant'),
 pairs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair, text AS u, reply AS a FROM back WHERE b <= 5)"""


def prompt_messages(spark, sf_dir):
    from ..engine import last_turns

    h = last_turns(table(spark, sf_dir, "conversations"))
    m = h.select("conv_id", context.messages(F.lit(None).cast("string"), F.col("history"), F.lit("?")).alias("m"))
    return m.select("conv_id", F.posexplode("m").alias("pos", "e")).select("conv_id", "pos", "e.role", "e.content")


def paper_api_view(spark, sf_dir):
    from ..sources.papers import search_view

    return search_view(papers(spark, sf_dir).withColumn("pdf_url", F.lit(None).cast("string"))).select("id", "title", "authors_display", "summary", "published")


def paper_labels(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", T.paper_label(F.col("title"), T.published(F.col("year"))).alias("label"))


def normalize_ids(spark, sf_dir):
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "arXiv:").when(F.col("doc_id") % 3 == 1, "ARXIV:").otherwise(" arXiv:"), "arxiv_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("v"), (F.col("doc_id") % 12).cast("string"))).otherwise(" "))
    return papers(spark, sf_dir).select("doc_id", T.normalize_paper_id(raw).alias("paper_id"))


def valid_ids(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", "arxiv_id", T.is_modern_id(F.col("arxiv_id")).alias("modern"))


def safe_filenames(spark, sf_dir):
    title = F.concat(F.lit(" .a/b:"), "title", F.lit("?. "))
    return papers(spark, sf_dir).select("doc_id", T.safe_filename(title, F.col("arxiv_id")).alias("file"))


def _catalog(spark, sf_dir):
    """Every paper, with its whole title."""
    return papers(spark, sf_dir).select(F.col("doc_id").alias("id"), "arxiv_id", "title", F.array_join("authors", ", ").alias("authors"), "year", "category", F.lit("p").alias("pdf_path"), F.lit("t").alias("txt_path"), (F.col("doc_id") % 3 == 0).alias("is_vectorized"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))


_CATALOG = _PAPERS + """, cat AS (SELECT doc_id, arxiv_id, title, array_to_string(authors, ', ') AS authors, year, category, doc_id % 3 = 0 AS is_vectorized FROM papers)"""


def _known_and_new(papers: DataFrame) -> DataFrame:
    """Every paper, and as many with ids that no paper has."""
    return papers.unionByName(papers.withColumn("arxiv_id", F.concat(F.lit("new-"), "arxiv_id")))


def catalog_upsert(spark, sf_dir):
    """A changed copy of every paper and as many new ones, into the catalog of all."""
    new = _known_and_new(papers(spark, sf_dir)).select("arxiv_id", F.concat(F.lit("New: "), "title").alias("title"), F.array_join("authors", ", ").alias("authors"), F.lit(2030).alias("year"), F.lit("new").alias("category"), F.lit("p2").alias("pdf_path"), F.lit("t2").alias("txt_path"), F.col("doc_id").alias("seq"))
    return catalog.upsert(_catalog(spark, sf_dir), new).select("arxiv_id", "title", "authors", "year", "category", "pdf_path", "is_vectorized")


def mark_vectorized(spark, sf_dir):
    """An id of every paper, those of odd numbers changed so that the catalog does not know them."""
    ids = papers(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 2 == 1, "new-").otherwise(""), "arxiv_id").alias("arxiv_id"))
    return catalog.mark_vectorized(_catalog(spark, sf_dir), ids).select("arxiv_id", "is_vectorized")


def titles_lookup(spark, sf_dir):
    return catalog.titles(_catalog(spark, sf_dir), _known_and_new(papers(spark, sf_dir)).select(F.concat("arxiv_id", F.lit(".txt")).alias("arxiv_id")))


def category_year_scan(spark, sf_dir):
    return importer.search(papers(spark, sf_dir), "en", 2010, 50).select("arxiv_id", "title", "year", "relevance")


def _targets(spark):
    return spark.createDataFrame([("en", 180), ("fr", 40), ("de", 500), ("es", 0)], "category string, target int")


def quota_import(spark, sf_dir):
    return importer.quota(papers(spark, sf_dir), _targets(spark), batch=10)


def _results(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", "category", (F.col("doc_id") % 9 != 0).alias("success"), F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 30).otherwise(0).cast("int").alias("chunks"), F.when(F.col("doc_id") % 18 == 0, "下载失败").alias("error"))


def import_summary(spark, sf_dir):
    return importer.summary(_results(spark, sf_dir))


def import_status(spark, sf_dir):
    return importer.status(_results(spark, sf_dir))


def skipped_counts(spark, sf_dir):
    return importer.skipped(papers(spark, sf_dir))


def _migrations(spark, sf_dir):
    """A file for every document, of which every fifth has a name that is no migration's; every third version is applied, and for
    every seventh document one whose file is gone."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    named = F.concat(F.when(i % 5 == 1, "v").otherwise("V"), i.cast("string"), F.when(i % 5 == 2, "_").otherwise("__"), F.coalesce("source", F.lit("none")), F.when(i % 5 == 3, ".txt").otherwise(".sql"))
    version = F.concat(i.cast("string"), F.lit("__"), F.coalesce("source", F.lit("none")))
    applied = d.where(i % 3 == 0).select(version.alias("version")).unionByName(d.where(i % 7 == 0).select(F.concat(version, F.lit("_gone")).alias("version")))
    return migrations.files(d.select(named.alias("name"))), applied


def pending_migrations(spark, sf_dir):
    return migrations.pending(*_migrations(spark, sf_dir)).select("version", "name")


def migration_status(spark, sf_dir):
    return migrations.status(*_migrations(spark, sf_dir))


def statement_split(spark, sf_dir):
    sql = F.concat(F.lit("CREATE x; ;\n"), F.col("source"), F.lit(" ;;"), F.col("lang"), F.lit(";"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.statements(sql)).alias("pos", "statement"))


def segmented_addresses(spark, sf_dir):
    """Words that run together in every page's address, cut by the words of all documents (5 occurrences or more, 12 letters at
    most): the cheapest path of each run of letters."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).where(F.length("w") <= 12).groupBy("w").agg(F.count("*").alias("n")).where("n >= 5")
    lexicon = segment.Lexicon.of({r.w: r.n for r in segmentation.most_frequent(words, 50_000).collect()}, None, "[a-z]+")
    cut = segment.applied(F.col("url"), lexicon, lambda own, t: own.tokens(t, r"(?!)"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(cut).alias("pos", "word"))


_SEGMENTED = """WITH RECURSIVE c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents) WHERE length(w) <= 12 GROUP BY w HAVING count(*) >= 5),
 upto AS (SELECT p, sum(k) OVER (ORDER BY p DESC) AS u FROM (SELECT floor(log2(n) * 16) AS p, count(*) AS k FROM c GROUP BY p)),
 dict AS (SELECT w, n FROM c WHERE floor(log2(n) * 16) >= (SELECT min(p) FROM upto WHERE u <= 50000)),
 cost AS (SELECT w, CAST(round((ln(t) - ln(n)) * 1000000) AS BIGINT) AS c FROM dict, (SELECT sum(n) AS t FROM dict)),
 fl AS (SELECT CAST(round(ln(coalesce(sum(n), 1)) * 1000000) AS BIGINT) AS f FROM dict),
 lists AS (SELECT page_id, regexp_extract_all(url, '[a-z]+') AS l FROM pages),
 runs AS (SELECT page_id, unnest(l) AS run, unnest(range(len(l))) AS r FROM lists),
 dp AS (SELECT DISTINCT run, 0 AS i, [CAST(0 AS BIGINT)] AS best, [CAST(0 AS BIGINT)] AS start FROM runs
  UNION ALL SELECT run, i + 1, best || [m.c], start || [m.j] FROM (SELECT run, i, best, start, min({'c': best[j + 1] + coalesce(c, f), 'j': j}) AS m
   FROM (SELECT *, unnest(range(greatest(0, i - 11), i + 1)) AS j FROM dp WHERE i < length(run)) LEFT JOIN cost ON w = substring(run, CAST(j + 1 AS INT), CAST(i + 1 - j AS INT)), fl WHERE c IS NOT NULL OR j = i GROUP BY run, i, best, start)),
 back AS (SELECT run, start, CAST(i AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ws FROM dp WHERE i = length(run)
  UNION ALL SELECT run, start, start[n + 1], [substring(run, CAST(start[n + 1] + 1 AS INT), CAST(n - start[n + 1] AS INT))] || ws FROM back WHERE n > 0),
 done AS (SELECT run, ws FROM back WHERE n = 0),
 parts AS (SELECT page_id, r, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM runs JOIN done USING (run))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY r, k) - 1 AS INT) AS pos, word FROM parts"""


def chunks_recursive(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.col("text").alias("page_content"))
    return chunking.split_documents(docs, "doc_id", paged=False).select("doc_id", "chunk_index", "page_content")


def chunks_fixed_stride(spark, sf_dir):
    return chunking.fixed_stride(table(spark, sf_dir, "documents"))


def dedup_by_content(spark, sf_dir):
    return index.distinct_contents(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "copies")


def _as_chunks(spark, sf_dir):
    """Every document as one chunk; its number is its source."""
    from .. import schemas

    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.lit(None).cast("string").alias("chunk_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source"), *[F.lit(None).cast("string").alias(c) for c in ("arxiv_id", "title", "category")], F.lit(0).alias("page"), F.lit(0).alias("chunk_index"), F.col("text").alias("page_content"), F.lit(None).cast("map<string,string>").alias("metadata"))
    assert chunks.schema.simpleString() == spark.createDataFrame([], schemas.CHUNKS).schema.simpleString()
    return chunks


def append_documents(spark, sf_dir):
    """All documents added to an index, all of them again as a second batch, and the first batch once more, which adds nothing: the
    chunks that the index then holds."""
    from ..session import work_path

    own = index.Index(spark, work_path(spark, "index"), letters)
    for batch in ("batch-1", "batch-2", "batch-1"):
        own.add(_as_chunks(spark, sf_dir), batch=batch)
    return own.read("chunks").select(F.col("source").cast("long").alias("doc_id"), F.md5(F.col("page_content").cast("binary")).alias("text_md5"), F.substring("chunk_id", 7, 1).cast("int").alias("batch"))


def label_select(spark, sf_dir):
    """The first paper with each label, as a list shown to users would resolve it."""
    p = papers(spark, sf_dir).select("doc_id", T.paper_label(F.col("title"), T.published(F.col("year"))).alias("label"))
    return catalog.first_with_label(p)


def history_structs(spark, sf_dir):
    lists = F.array(F.array("source", "lang"), F.array("lang"))
    h = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.pair_structs(lists)).alias("pos", "h"))
    return h.select("doc_id", "pos", "h.u", "h.a")


def metadata_defaults(spark, sf_dir):
    m = F.from_json(F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("arxiv_id"))), "map<string,string>")
    path = F.concat(F.lit("in.d/"), "source", F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.default_of(m, "arxiv_id", "unknown").alias("arxiv_id"), T.suffix(path).alias("suffix"))


def retry_delays(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("attempt"), F.col("source").contains("9").alias("limited"))
    return e.select("doc_id", T.retry_delay(F.col("attempt"), F.col("limited")).alias("delay"))


def answers(spark, sf_dir):
    """Every benchmark item as a question to both legs: context, extractive completion and numbered citations."""
    from ..session import work_path, written

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    e, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    legs = hybrid.vector_leg(knn.nearest_batch(e, asked, 2 * K)), hybrid.bm25_leg(bm25.best(_index(spark, sf_dir), bm25.query_terms(items), 2 * K), K)
    p = papers(spark, sf_dir).select(F.col("doc_id").alias("id"), "arxiv_id", "title")
    best = written(_fused(spark, docs, *legs), work_path(spark, "best"))
    hits = written(p.select("id", "arxiv_id").join(F.broadcast(best), "id"), work_path(spark, "hits"))  # k rows a question
    questions = items.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array().cast("array<struct<u:string,a:string>>").alias("history"))
    return context.answers(questions, hits, p)


def letters(texts: list[str]):
    """An embedder that SQL can follow: how often each letter from a to z occurs, at unit length."""
    import numpy as np

    out = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float).reshape(len(texts), 26)
    norm = np.sqrt((out * out).cumsum(axis=1)[:, -1:])
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def index_search(spark, sf_dir):
    """All documents added to an index twice, in two batches; the best texts of every benchmark item by both legs."""
    from ..config import Settings
    from ..engine import Engine
    from ..session import work_path

    chunks = _as_chunks(spark, sf_dir)
    engine = Engine(spark, Settings(index_dir=work_path(spark, "index")), embedder=letters)
    for batch in ("batch-1", "batch-2"):
        engine.index.add(chunks, batch=batch)
    best = engine.hybrid_search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))
    return best.select("qid", "rank", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 6).alias("score"), "vec_rank", "bm25_rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [hybrid_topk, hybrid_batch_questions, bm25_topk, bm25_term_stats, bm25_doc_len, bm25_corpus, knn_l2_topk, knn_cutoff, context_by_source, ordered_sources, citations, history_last5, prompt_messages, paper_api_view, paper_labels, normalize_ids, valid_ids, safe_filenames, catalog_upsert, mark_vectorized, titles_lookup, category_year_scan, quota_import, import_summary, import_status, skipped_counts, pending_migrations, migration_status, statement_split, segmented_addresses, chunks_recursive, chunks_fixed_stride, dedup_by_content, append_documents, label_select, history_structs, metadata_defaults, retry_delays, answers, index_search]
    return {f.__name__: f for f in names}


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[\s\x0b]+'), lambda w: w <> ''))"


def _answers(hybrid_all: str, title: str) -> str:
    """Fused hits with their papers, contexts and citations by source, and the first sentence that shares most words."""
    kept = "coalesce(arg_max(doc_id, vr), arg_min(doc_id, br)) AS doc_id"
    ranked = hybrid_all.replace("ORDER BY s DESC, doc_id DESC", "ORDER BY round(s, 9) DESC, doc_id DESC")
    return f"""{ranked}, {_PAPERS}, kept AS (SELECT qid, text, {kept} FROM u JOIN documents USING (doc_id) GROUP BY qid, text),
 hits AS (SELECT r.qid, r.rank, r.text, coalesce(arxiv_id, 'unknown') AS source FROM r JOIN kept ON kept.qid = r.qid AND kept.text = r.text JOIN papers USING (doc_id) WHERE rank <= 5),
 src AS (SELECT qid, source, min(rank) AS first, string_agg(text, chr(10) ORDER BY rank) AS text FROM hits GROUP BY qid, source),
 ctx AS (SELECT qid, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY first) AS body FROM src GROUP BY qid),
 lists AS (SELECT item_id AS qid, b.text AS question, body, list_filter(list_transform(string_split(replace(body, chr(10), '. '), '. '), lambda x: trim(x, {_SPACE})), lambda x: x <> '') AS l FROM benchmark b LEFT JOIN ctx ON qid = item_id),
 said AS (SELECT qid, question, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM lists),
 best AS (SELECT qid, s FROM said QUALIFY row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect({_WORDS.format('question')}, {_WORDS.format('s')})) DESC, i) = 1),
 t AS (SELECT arxiv_id AS key, any_value(title) AS title FROM papers GROUP BY arxiv_id),
 n AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY first) AS number, coalesce(title, source) AS t FROM src LEFT JOIN t ON key = replace(source, '.txt', '')),
 refs AS (SELECT qid, string_agg(CAST(number AS VARCHAR) || '. [' || source || '] ' || {title}, chr(10) ORDER BY number) AS refs FROM n GROUP BY qid)
SELECT CAST(lists.qid AS BIGINT) AS qid, question, CASE WHEN body IS NULL THEN '{context.NO_CONTEXT}' ELSE coalesce(s, '') END || CASE WHEN refs IS NULL THEN '' ELSE '{context.REFERENCES}' || refs END AS answer FROM lists LEFT JOIN best ON best.qid = lists.qid LEFT JOIN refs ON refs.qid = lists.qid"""


_TWICE = f"""WITH twice AS (SELECT 1 AS batch, doc_id, text FROM documents UNION ALL SELECT 2, doc_id, text FROM documents),
 tok AS (SELECT batch, doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS t FROM twice),
 tf AS (SELECT batch, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT batch, doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
 st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
 raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
 terms AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
 q AS (SELECT qid, term, count(*) AS qn FROM (SELECT item_id AS qid, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT qid, batch, doc_id, {_SCORE} AS s FROM tf JOIN q USING (term) JOIN terms USING (term), st GROUP BY ALL),
 b AS (SELECT qid, batch, doc_id, s, s / greatest(max(s) OVER (PARTITION BY qid), 0) AS bn, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, batch DESC, doc_id DESC) AS rk FROM sc),
 letters AS (SELECT key, list_transform(c, lambda x: CAST(CASE WHEN list_sum(list_transform(c, lambda y: y * y)) > 0 THEN x / sqrt(list_sum(list_transform(c, lambda y: y * y))) ELSE 0 END AS FLOAT)) AS e
  FROM (SELECT key, list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda x: CAST(length(text) - length(replace(text, x, '')) AS DOUBLE)) AS c FROM (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark))),
 near AS (SELECT item_id AS qid, doc_id, list_sum(list_transform(range(1, 27), lambda i: (CAST(d.e[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) ** 2)) AS d2 FROM benchmark JOIN letters q ON q.key = 'q' || item_id, documents JOIN letters d ON d.key = 'd' || doc_id),
 v AS (SELECT qid, batch, doc_id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, batch, doc_id) AS rk FROM near, (VALUES (1), (2)) b(batch)),
 u AS (SELECT qid, doc_id, 0.7 / (1 + d2) AS vs, NULL AS bs, rk AS vr, NULL AS br FROM v WHERE rk <= 10 AND d2 <= 1.5 UNION ALL SELECT qid, doc_id, NULL, 0.3 * bn, NULL, rk FROM b WHERE rk <= 10 AND s > 0),
 g AS (SELECT qid, text, coalesce(min(vs), 0) + coalesce(sum(bs), 0) AS score, min(vr) AS vec_rank, min(br) AS bm25_rank FROM u JOIN documents USING (doc_id) GROUP BY qid, text),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM g)
SELECT CAST(qid AS BIGINT) AS qid, CAST(rank AS INT) AS rank, md5(text) AS text_md5, round(score, 6) AS score, CAST(vec_rank AS INT) AS vec_rank, CAST(bm25_rank AS INT) AS bm25_rank FROM r WHERE rank <= 5"""


_D2 = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) ** 2))"
_RESULTS = _PAPERS + ", res AS (SELECT arxiv_id, category, doc_id % 9 <> 0 AS success, CAST(CASE WHEN doc_id % 9 <> 0 THEN doc_id % 30 ELSE 0 END AS INT) AS chunks, CASE WHEN doc_id % 18 = 0 THEN '下载失败' END AS error FROM papers)"
_MIGRATIONS = """f AS (SELECT CASE WHEN doc_id % 5 = 1 THEN 'v' ELSE 'V' END || doc_id || CASE WHEN doc_id % 5 = 2 THEN '_' ELSE '__' END || coalesce(source, 'none') || CASE WHEN doc_id % 5 = 3 THEN '.txt' ELSE '.sql' END AS name FROM documents),
 found AS (SELECT name, regexp_extract(name, '^V([0-9]+__[0-9A-Za-z_]+)[.]sql$', 1) AS version FROM f WHERE version <> ''),
 applied AS (SELECT doc_id || '__' || coalesce(source, 'none') AS version FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id || '__' || coalesce(source, 'none') || '_gone' FROM documents WHERE doc_id % 7 = 0)"""


def oracle_sql() -> dict[str, str]:
    hybrid_one = _HYBRID % ("SELECT 0 AS qid, term FROM (VALUES " + ", ".join(f"('{t}')" for t in QUERY) + ") v(term)", "SELECT 0 AS qid, embedding AS qe FROM embeddings WHERE vec_id = 0")
    hybrid_all = _HYBRID % ("SELECT item_id AS qid, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM benchmark", "SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
    by_source, by_paper = (_HITS.replace("SOURCE_OF_HIT", x) for x in ("source", "arxiv_id || '.txt'"))
    title = "CASE WHEN length(t) > 80 THEN substring(t, 1, 77) || '...' ELSE t END"
    return {
        "hybrid_topk": f"{hybrid_one} SELECT CAST(rank AS INT) AS rank, text, round(score, 6) AS score, CAST(vec_rank AS INT) AS vec_rank, CAST(bm25_rank AS INT) AS bm25_rank FROM r WHERE rank <= 5",
        "hybrid_batch_questions": f"{hybrid_all} SELECT CAST(qid AS BIGINT) AS qid, CAST(rank AS INT) AS rank, md5(text) AS text_md5, round(score, 6) AS score, CAST(vec_rank AS INT) AS vec_rank, CAST(bm25_rank AS INT) AS bm25_rank FROM r WHERE rank <= 5",
        "bm25_topk": f"WITH {_BM25}, {_Q} SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, {_SCORE} AS s FROM tf JOIN q USING (term) JOIN terms USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id) ORDER BY s DESC, doc_id DESC LIMIT 10",
        "bm25_term_stats": f"WITH {_BM25} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM terms",
        "bm25_doc_len": "SELECT doc_id AS id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS BIGINT) AS dl FROM documents",
        "bm25_corpus": "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))), 6) AS avgdl FROM documents",
        "answers": _answers(hybrid_all, title),
        "index_search": _TWICE,
        "knn_l2_topk": f"SELECT vec_id, round(d2, 6) AS d2, round(1 / (1 + d2), 6) AS similarity FROM (SELECT e.vec_id, {_D2} AS d2 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d2, vec_id LIMIT 10",
        "knn_cutoff": f"SELECT qid, id, round(d2, 6) AS d2, rk FROM (SELECT qid, id, d2, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INT) AS rk FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_D2} AS d2 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rk <= 20 AND d2 <= 1.5",
        "context_by_source": f"WITH {by_source} SELECT qid, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY first) AS context FROM g GROUP BY qid",
        "ordered_sources": f"WITH {by_source} SELECT qid, source, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INT) AS place FROM g",
        "citations": f"WITH {by_paper}, t AS (SELECT arxiv_id AS key, any_value(title) AS title FROM papers GROUP BY arxiv_id), n AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY first) AS number, coalesce(title, source) AS t FROM g LEFT JOIN t ON key = replace(source, '.txt', '')) SELECT qid, CAST(number AS INT) AS number, source, CAST(number AS VARCHAR) || '. [' || source || '] ' || {title} AS line FROM n",
        "history_last5": f'WITH {_HISTORY} SELECT conv_id, CAST(pair AS INT) AS pair, u AS "user", a AS assistant FROM pairs',
        "prompt_messages": f"WITH {_HISTORY}, m AS (SELECT conv_id, 2 * pair - 1 AS pos, 'user' AS role, u AS content FROM pairs UNION ALL SELECT conv_id, 2 * pair, 'assistant', a FROM pairs UNION ALL SELECT conv_id, 0, 'system', '{context.SYSTEM_PROMPT}{context.NO_CONTEXT}' FROM (SELECT DISTINCT conv_id FROM pairs) UNION ALL SELECT conv_id, 2 * max(pair) + 1, 'user', '?' FROM pairs GROUP BY conv_id) SELECT conv_id, CAST(pos AS INT) AS pos, role, content FROM m",
        "paper_api_view": f"WITH {_PAPERS} SELECT arxiv_id AS id, title, array_to_string(authors[1:3], ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END AS authors_display, substring(summary, 1, 500) AS summary, CASE WHEN year IS NOT NULL AND year <> 0 THEN CAST(year AS VARCHAR) ELSE '未知' END AS published FROM papers",
        "paper_labels": f"WITH {_PAPERS} SELECT doc_id, substring(title, 1, 60) || '... (' || CASE WHEN year IS NOT NULL AND year <> 0 THEN CAST(year AS VARCHAR) ELSE '未知' END || ')' AS label FROM papers",
        "normalize_ids": rf"WITH {_PAPERS}, r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'arXiv:' WHEN 1 THEN 'ARXIV:' ELSE ' arXiv:' END || arxiv_id || CASE WHEN doc_id % 2 = 0 THEN 'v' || CAST(doc_id % 12 AS VARCHAR) ELSE ' ' END AS raw FROM papers) SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(raw, '^(?i)arxiv:', ''), 'v\d+$', ''), '/', ''), '^\s+|\s+$', '', 'g') AS paper_id FROM r",
        "valid_ids": rf"WITH {_PAPERS} SELECT doc_id, arxiv_id, regexp_matches(arxiv_id, '^\d{{4}}\.\d{{4,5}}$') AS modern FROM papers",
        "safe_filenames": rf"""WITH {_PAPERS}, r AS (SELECT doc_id, arxiv_id, ' .a/b:' || title || '?. ' AS title FROM papers), s AS (SELECT *, substring(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', '', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 80) AS safe FROM r) SELECT doc_id, arxiv_id || '_' || CASE WHEN safe = '' THEN arxiv_id ELSE safe END || '_' || substring(md5(title), 1, 6) || '.pdf' AS file FROM s""",
        "catalog_upsert": f"WITH {_CATALOG}, n AS (SELECT p || arxiv_id AS arxiv_id, 'New: ' || title AS title, array_to_string(authors, ', ') AS authors FROM papers, (VALUES (''), ('new-')) v(p)) SELECT n.arxiv_id, n.title, n.authors, 2030 AS year, coalesce(cat.category, CASE WHEN cat.arxiv_id IS NULL THEN 'new' END) AS category, CASE WHEN cat.arxiv_id IS NULL THEN 'p2' ELSE 'p' END AS pdf_path, coalesce(is_vectorized, false) AS is_vectorized FROM n LEFT JOIN cat ON cat.arxiv_id = n.arxiv_id",
        "mark_vectorized": f"WITH {_CATALOG} SELECT arxiv_id, is_vectorized OR doc_id % 2 = 0 AS is_vectorized FROM cat",
        "titles_lookup": f"WITH {_CATALOG} SELECT arxiv_id, title FROM cat",
        "category_year_scan": f"WITH {_PAPERS} SELECT arxiv_id, title, year, relevance FROM papers WHERE category = 'en' AND year = 2010 ORDER BY relevance, arxiv_id LIMIT 50",
        "quota_import": rf"""WITH RECURSIVE {_PAPERS}, targets AS (SELECT * FROM (VALUES ('en', 180), ('fr', 40), ('de', 500), ('es', 0)) v(category, target)), ranked AS (SELECT *, row_number() OVER (PARTITION BY category, year ORDER BY relevance, arxiv_id) AS r FROM papers WHERE year BETWEEN 2000 AND 2026), years AS (SELECT category, year, list(arxiv_id ORDER BY r) AS ids FROM ranked WHERE r <= 10 GROUP BY ALL), walk AS (SELECT category, target, 2027 AS y, CAST([] AS VARCHAR[]) AS got FROM targets UNION ALL SELECT w.category, target, y - 1, CASE WHEN len(got) >= target THEN got ELSE got || list_filter(coalesce(ids, [])[1:least(10, target - len(got))], lambda i: regexp_matches(i, '^\d{{4}}\.\d{{4,5}}$')) END FROM walk w LEFT JOIN years s ON s.category = w.category AND s.year = y - 1 WHERE y > 2000), done AS (SELECT category, got[1:target] AS got FROM walk WHERE y = 2000) SELECT category, unnest(got) AS arxiv_id, CAST(unnest(range(1, len(got) + 1)) AS INT) AS place FROM done""",
        "import_summary": f"WITH {_RESULTS} SELECT category, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, CAST(sum(chunks) AS BIGINT) AS chunks FROM res GROUP BY category",
        "import_status": f"WITH {_RESULTS} SELECT arxiv_id, CASE WHEN success THEN 'success' ELSE 'error' END AS status, CASE WHEN success THEN '已添加 ' || arxiv_id ELSE coalesce(error, '未知错误') END AS message, chunks FROM res",
        "skipped_counts": rf"WITH {_PAPERS} SELECT category, count(*) AS fetched, count(*) FILTER (regexp_matches(arxiv_id, '^\d{{4}}\.\d{{4,5}}$')) AS valid, count(*) FILTER (NOT regexp_matches(arxiv_id, '^\d{{4}}\.\d{{4,5}}$')) AS skipped FROM papers GROUP BY category",
        "pending_migrations": f"WITH {_MIGRATIONS} SELECT version, name FROM found WHERE version NOT IN (SELECT version FROM applied) ORDER BY version",
        "migration_status": f"WITH {_MIGRATIONS} SELECT version, CAST(NULL AS VARCHAR) AS name, 'applied' AS state FROM applied UNION ALL SELECT version, name, 'pending' FROM found WHERE version NOT IN (SELECT version FROM applied)",
        "statement_split": r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split('CREATE x; ;' || chr(10) || source || ' ;;' || lang || ';', ';'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents) SELECT doc_id, CAST(unnest(range(0, len(l))) AS INT) AS pos, unnest(l) AS statement FROM s",
        "chunks_fixed_stride": "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 150) / 650.0) AS BIGINT)))) AS i FROM documents) SELECT doc_id, CAST(i AS INT) AS chunk_index, substring(text, i * 650 + 1, 800) AS chunk FROM c",
        "segmented_addresses": _SEGMENTED,
        "dedup_by_content": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
        "append_documents": "SELECT doc_id, md5(text) AS text_md5, CAST(batch AS INT) AS batch FROM documents, (VALUES (1), (2)) v(batch)",
        "label_select": f"WITH {_PAPERS} SELECT substring(title, 1, 60) || '... (' || CASE WHEN year IS NOT NULL AND year <> 0 THEN CAST(year AS VARCHAR) ELSE '未知' END || ')' AS label, min(doc_id) AS doc_id FROM papers GROUP BY 1",
        "history_structs": "SELECT doc_id, CAST(0 AS INT) AS pos, source AS u, lang AS a FROM documents UNION ALL SELECT doc_id, 1, lang, NULL FROM documents",
        "metadata_defaults": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS arxiv_id, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '' END AS suffix FROM documents",
        "retry_delays": "SELECT doc_id, CAST(CASE WHEN contains(source, '9') THEN 5 * (doc_id % 3 + 1) ELSE 2 ** (doc_id % 3) END AS INT) AS delay FROM documents",
    }
