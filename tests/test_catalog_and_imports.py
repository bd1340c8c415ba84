import datetime

from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.engine import Engine
from lorekeep.config import Settings
from lorekeep.operators import catalog, importer, migrations
from lorekeep.operators.index import Index
from lorekeep.sources import files, papers
from lorekeep.streaming import ingest

T0 = datetime.datetime(2024, 1, 1)


def test_upsert_keeps_what_it_must(spark):
    old = spark.createDataFrame([(1, "a", "old", "x", 2000, "c", "p", "t", True, T0)], schemas.CATALOG)
    new = spark.createDataFrame([("a", "new", "y", None, "other", "p2", "t2", 0), ("b", "first", "z", 1, "c1", "p1", "t1", 1), ("b", "last", "z", 2, "c2", "p2", "t2", 2), (None, "n", "n", 1, "c", "p", "t", 3)], "arxiv_id string, title string, authors string, year int, category string, pdf_path string, txt_path string, seq int")
    got = {r.arxiv_id: r for r in catalog.upsert(old, new).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.title, a.authors, a.year, a.category, a.pdf_path, a.is_vectorized, a.created_at) == ("new", "y", None, "c", "p", True, T0)
    assert (b.title, b.year, b.category, b.is_vectorized) == ("last", 2, "c1", False)
    marked = catalog.mark_vectorized(catalog.upsert(old, new), ["b"])
    assert marked.where("arxiv_id = 'b'").first().is_vectorized
    assert catalog.mark_vectorized(old, []) is old
    assert [r.title for r in catalog.titles(old, ["a.txt", "zz"]).collect()] == ["old"] and catalog.titles(old, []).count() == 0


def walk(rows, target, batch):
    """The quota rule as a loop."""
    got, year = [], 2026
    while len(got) < target and year >= 2000:
        page = sorted((r for r in rows if r[1] == year), key=lambda r: (r[2], r[3]))[: min(batch, target - len(got))]
        got += [r[3] for r in page if importer_valid(r[3])]
        year -= 1
    return got[:target]


def importer_valid(i):
    import re

    return bool(re.fullmatch(r"\d{4}\.\d{4,5}", i))


def test_quota_follows_the_loop(spark):
    import random

    r = random.Random(4)
    rows = [(c, r.randint(2000, 2026), r.randint(0, 5), f"{r.randint(1000, 9999)}.{r.randint(1000, 99999)}" if r.random() < 0.7 else f"old/{r.randint(0, 10**6)}") for c in "ab" for _ in range(200)]
    df = spark.createDataFrame(rows, "category string, year int, relevance int, arxiv_id string")
    for target, batch in ((7, 3), (50, 4), (1000, 5), (0, 3)):
        got = importer.quota(df, spark.createDataFrame([("a", target), ("b", target)], "category string, target int"), batch=batch).orderBy("category", "place").collect()
        for c in "ab":
            assert [g.arxiv_id for g in got if g.category == c] == walk([x for x in rows if x[0] == c], target, batch)


def test_counts_and_status(spark):
    res = spark.createDataFrame([("a", "c", True, 3, None), ("b", "c", False, 0, "下载失败"), ("d", "e", False, None, None)], "arxiv_id string, category string, success boolean, chunks int, error string")
    assert {(r.category, r.succeeded, r.failed, r.chunks) for r in importer.summary(res).collect()} == {("c", 1, 1, 3), ("e", 0, 1, 0)}
    assert [r.message for r in importer.status(res).orderBy("arxiv_id").collect()] == ["已添加 a", "下载失败", "未知错误"]
    assert importer.skipped(spark.createDataFrame([("c", "2401.01234"), ("c", "x")], "category string, arxiv_id string")).first().asDict() == {"category": "c", "fetched": 2, "valid": 1, "skipped": 1}


def test_migrations(spark, tmp_path):
    (tmp_path / "V10__b.sql").write_text("CREATE TABLE mig_b (x int) USING parquet;\n ;", encoding="utf-8")
    (tmp_path / "V9__c.sql").write_text("DROP TABLE mig_b", encoding="utf-8")
    (tmp_path / "other.sql").write_text("nonsense", encoding="utf-8")
    spark.sql("DROP TABLE IF EXISTS mig_versions")
    assert migrations.migrate(spark, str(tmp_path), "mig_versions") == ["10__b", "9__c"]  # by text, not by number
    assert migrations.migrate(spark, str(tmp_path), "mig_versions") == []
    made = migrations.create(spark, str(tmp_path), "next")
    state = migrations.status(migrations.listing(spark, str(tmp_path)), spark.table("mig_versions")).collect()
    assert [r.state for r in state] == ["applied", "applied", "pending"] and made.endswith("__next.sql")
    assert migrations.listing(spark, str(tmp_path / "none")).count() == 0


def pdf(*pages):
    body = "".join(f"<< /Length 1 >>\nstream\nBT ({p}) Tj ET\nendstream\n" for p in pages)
    return b"%PDF-1.4\n" + body.encode()


def test_files_index_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("the cat sat on the mat", encoding="utf-8")
    (folder / "b.pdf").write_bytes(pdf("page one", "page two"))
    (folder / "bad.pdf").write_bytes(b"nothing")
    (folder / "c.PDF").write_bytes(pdf("no"))
    rows = files.load_files(spark, str(folder)).orderBy("source", "page").collect()
    assert all(r.source.startswith("file:") and f"{folder}/" in r.source for r in rows)
    assert [(r.source.rpartition("/")[2], r.page, r.page_content) for r in rows] == [("a.txt", 0, "the cat sat on the mat"), ("b.pdf", 0, "page one"), ("b.pdf", 1, "page two"), ("bad.pdf", None, None)]
    assert rows[3].metadata["error"].startswith("PDF解析失败")
    index = Index(spark, str(tmp_path / "index"))
    assert index.read("chunks").count() == 0
    chunks = ingest.chunk_rows(files.load_files(spark, str(folder)).where("page_content is not null"))
    assert index.add(chunks) == 3 and index.add(chunks, dedup=True) == 0 and index.add(chunks) == 3
    assert index.read("chunks").count() == 6 and index.bm25().corpus.first().n == 6
    stream = Index(spark, str(tmp_path / "stream"))
    ingest.follow(spark, str(folder), stream, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert [r.page_content for r in stream.read("chunks").collect()] == ["the cat sat on the mat"]
    assert not stream.clear("yes") and stream.clear("YES") and stream.batches() == []


def test_paper_source(spark, tmp_path):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/hep-th/9901001v1</id><title>A
     title</title><author><name>N One</name></author><published>2020-05-01T00:00:00Z</published><summary>s</summary><link title="pdf" href="http://x/pdf"/></entry></feed>"""
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(papers.parse_feed(feed.encode()))], "relevance int, id string, title string, authors array<string>, published string, summary string, pdf_url string")
    info = papers.paper_info(raw).first()
    assert (info.arxiv_id, info.title, info.year, info.category) == ("hep-th9901001", "A title", 2020, "")
    (tmp_path / "feed").write_text(feed, encoding="utf-8")
    got = papers.search_remote(spark, "cat:x", (tmp_path / "feed").as_uri() + "#", 1).first()
    assert got.title == "A title"
    assert papers.query_for("cs.CL", 2020) == "cat:cs.CL AND submittedDate:[202001010000 TO 202012312359]" and papers.query_for("c", 0) == "cat:c"
    waits, answers = [], iter([RuntimeError("HTTP 429"), RuntimeError("x"), b"short"])

    def get(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert papers.with_retries(get, "i", sleep=waits.append) is None and waits == [5, 2]


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, Settings(index_dir=str(tmp_path / "i"), text_dir=str(tmp_path / "t"), database="lore_test"), fetch=None)
    catalog.clean(spark, "lore_test", "YES")
    wanted = spark.createDataFrame([("2401.00001", "Cats", ["A", "B"], 2024, "", "s", None), ("2401.00002", "Lost", [], None, "", "s", None)], schemas.PAPER_INFO)
    got = spark.createDataFrame([("2401.00001", bytearray(pdf("cats chase mice", "dogs bark")))], "arxiv_id string, content binary")
    res = {r.arxiv_id: r for r in e.import_papers(wanted, "manual", got).collect()}
    assert res["2401.00001"].success and res["2401.00001"].chunks == 1 and res["2401.00002"].error == "下载失败"
    row = spark.table("lore_test.papers").first()
    assert (row.title, row.authors, row.is_vectorized) == ("Cats", "A, B", True) and spark.table("lore_test.import_log").count() == 2
    q = spark.createDataFrame([(0, "cats chase", None)], "qid long, question string, history array<struct<u:string,a:string>>")
    assert e.answer(q).first().answer.endswith("1. [2401.00001] Cats")
    assert e.quotas().agg(F.sum("target")).first()[0] == 1000
    assert catalog.clean(spark, "lore_test", "no") is False
    catalog.clean(spark, "lore_test", "YES")
    assert spark.table("lore_test.papers").count() == 0


def settings(tmp_path, name):
    return Settings(index_dir=str(tmp_path / "i"), text_dir=str(tmp_path / "t"), pdf_dir=str(tmp_path / "p"), database=name)


def searched(e, *questions):
    q = e.spark.createDataFrame([(i, x) for i, x in enumerate(questions)], "qid long, question string")
    return [[(r.text, round(r.score, 6)) for r in e.hybrid_search(q, vector_weight=0.0).where(F.col("qid") == i).where("score > 0").orderBy("rank").collect()] for i in range(len(questions))]


def test_equal_files_and_texts_stay_apart(spark, tmp_path):
    e = Engine(spark, settings(tmp_path, "lore_apart"))
    for name, text in (("one", "cats chase mice"), ("two", "dogs bark at night"), ("three", "birds sing"), ("four", "wolves howl")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text(text, encoding="utf-8")
        assert e.upload(str(tmp_path / name)) == 1
    assert searched(e, "cats", "bark birds") == [[("cats chase mice", 0.3)], [("birds sing", 0.3), ("dogs bark at night", searched(e, "bark birds")[0][1][1])]]
    assert e.upload(str(tmp_path / "one")) == 1 and e.index.read("chunks").select("chunk_id").distinct().count() == 5
    # a text that was added again is two documents, and both copies add to its score
    docs = [["cats", "chase", "mice"], ["dogs", "bark", "at", "night"], ["birds", "sing"], ["wolves", "howl"], ["cats", "chase", "mice"]]
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    assert {r.term: r.df for r in e.index.bm25().terms.collect()} == df
    assert searched(e, "cats mice") == [[("cats chase mice", 0.6)]]
    before = searched(e, "cats", "sing mice")
    name = e.index.merge()
    assert e.index.batches() == [name] and searched(e, "cats", "sing mice") == before and e.index.merge() is None
    assert e.index.sweep() == 5 and e.index.batches() == [name] and searched(e, "cats", "sing mice") == before


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    i = Index(spark, str(tmp_path / "i"))
    chunks = ingest.chunk_rows(spark.createDataFrame([("s", 0, "some text", None)], schemas.PAGES))
    assert i.add(chunks, batch="stream-x-1") == 1 and i.add(chunks, batch="stream-x-1") == 0 and i.add(chunks, batch="stream-x-2") == 1
    # an attempt that broke off before its marker leaves files that do not count, and is written over
    chunks.write.parquet(str(tmp_path / "i/chunks/batch=stream-x-3"))
    assert i.read("chunks").count() == 2 and i.add(chunks, batch="stream-x-3") == 1 and i.read("chunks").count() == 3


def test_import_again_and_quotas(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def fetch(paper):
        with open(calls, "a", encoding="utf-8") as f:
            f.write(paper + "\n")
        if paper.endswith("9"):
            raise RuntimeError("gone")
        return pdf(f"text of {paper}") + b" " * 11_000

    e = Engine(spark, settings(tmp_path, "lore_again"), fetch=fetch)
    catalog.clean(spark, "lore_again", "YES")
    one = spark.createDataFrame([("2401.00001",)], "arxiv_id string")
    for _ in range(2):
        r = e.import_papers(one).collect()
        assert [(x.arxiv_id, x.success, x.chunks) for x in r] == [("2401.00001", True, 1)]
    assert open(calls).read().split() == ["2401.00001"]  # kept, so not fetched again
    row = spark.table("lore_again.papers").first()
    for path in (row.pdf_path, row.txt_path):
        assert spark.read.parquet(path).where("arxiv_id = '2401.00001'").count() == 1
    found = spark.createDataFrame([(f"24{y:02d}.{i:05d}", "T", ["A"], 2000 + y, c, "s", None, i) for c in ("x", "y") for y in (23, 24) for i in range(8)], f"{schemas.PAPER_INFO}, relevance int").where("category <> 'y' or year = 2024")
    real = e.import_papers
    e.import_papers = lambda w, c, d=None: real(w, c, d) if c == "x" else (_ for _ in ()).throw(ValueError("broken"))
    got = e.import_quotas({"y": 3, "x": 10}, found).collect()
    assert [(r.category, r.error) for r in got if r.category == "y"] == [("y", "ValueError: broken")]
    own = {r.arxiv_id for r in got if r.category == "x"}
    assert own == {f"2424.{i:05d}" for i in range(8)} | {"2423.00000", "2423.00001"}
    assert e.search_response("q", 5, found)[1] == 5
    assert not e.clean("no") and e.clean("YES") and e.index.batches() == [] and not (tmp_path / "p").exists()


def test_json(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2}]', encoding="utf-8")
    assert [r.a for r in files.read_json(spark, str(tmp_path / "x.json")).orderBy("a").collect()] == [1, 2]
    files.write_json(spark.range(3).toDF("a"), str(tmp_path / "y"))
    assert spark.read.json(str(tmp_path / "y")).count() == 3


def test_package_exports():
    import lorekeep

    assert lorekeep.Engine is Engine and lorekeep.Settings is Settings and callable(lorekeep.get_session)


def _files_of(spark, name):
    return {r.f: r.n for r in spark.table(name).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}


def test_only_touched_buckets_are_rewritten(spark):
    import pytest

    catalog.create_tables(spark, "bucketdb")
    columns = "arxiv_id string, title string, authors string, year int, category string, pdf_path string, txt_path string"
    rows = [(f"2401.{i:05d}", f"t{i}", "a", 2024, "c", "p", "x") for i in range(300)]
    new = spark.createDataFrame(rows, columns)
    touched = catalog.publish(spark, "bucketdb.papers", lambda known: catalog.upsert(known, new, F.lit(T0)), new)
    assert touched == list(range(catalog.BUCKETS)) and spark.table("bucketdb.papers").count() == 300
    before = _files_of(spark, "bucketdb.papers")
    one = new.limit(1).withColumn("title", F.lit("changed"))
    assert len(catalog.publish(spark, "bucketdb.papers", lambda known: catalog.upsert(known, one, F.lit(T0)), one)) == 1
    after = _files_of(spark, "bucketdb.papers")
    assert len(set(before) & set(after)) == catalog.BUCKETS - 1 and spark.table("bucketdb.papers").count() == 300
    assert spark.table("bucketdb.papers").where("title = 'changed'").count() == 1
    with pytest.raises(ZeroDivisionError):  # before anything is moved
        catalog.publish(spark, "bucketdb.papers", lambda known: 1 / 0, one)
    assert _files_of(spark, "bucketdb.papers") == after
    assert catalog.publish(spark, "bucketdb.papers", lambda known: catalog.mark_vectorized(known, one), one.limit(0)) == []
    catalog.publish(spark, "bucketdb.papers", lambda known: catalog.mark_vectorized(known, one), one)
    assert spark.table("bucketdb.papers").where("is_vectorized").count() == 1
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    spark.sql("DROP DATABASE bucketdb CASCADE")


def test_imports_read_what_they_want(spark, tmp_path):
    """Contents and texts of other papers are not asked for: the plans send the wanted ids to the scans."""
    e = Engine(spark, Settings(index_dir=f"{tmp_path}/i", pdf_dir=f"{tmp_path}/pdf", text_dir=f"{tmp_path}/txt", database="readdb"))
    spark.createDataFrame([(f"x{i}", "t", "f", bytearray(b"c" * 20_000), 20_000) for i in range(40)], "arxiv_id string, title string, file string, content binary, length long").write.parquet(f"{tmp_path}/pdf/batch-0")
    wanted = spark.createDataFrame([("x3", "t"), ("new", "t")], "arxiv_id string, title string")
    got = e._downloaded(wanted, "batch-1")
    assert [r.arxiv_id for r in got.collect()] == ["x3"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(arxiv_id, [" in plan
    spark.sql("DROP DATABASE readdb CASCADE")
