import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import blockmax, bm25
from lorekeep.operators.index import Index


def chunk_table(spark, texts, parts=3):
    rows = [(f"s{i}", t) for i, t in enumerate(texts)]
    null = lambda c, t="string": F.lit(None).cast(t).alias(c)
    return spark.createDataFrame(rows, "source string, page_content string").repartition(parts).select(null("chunk_id"), "source", *[null(c) for c in ("arxiv_id", "title", "category")], F.lit(0).alias("page"), F.lit(0).alias("chunk_index"), "page_content", null("metadata", "map<string,string>"))


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    out = [" ".join(r.choices(words, odds, k=r.randint(0, 40))) for _ in range(n)] + [None, "", "w1"] + ["same text w50 w50"] * 9
    return out + [" ".join(["w59"] * 8 + ["w58"] * 5)] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_top_equals_full_scores(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(blockmax, "RANGE", 8)
    monkeypatch.setattr(blockmax, "FIRST", 2)
    index = Index(spark, f"{tmp_path}/i")
    texts = corpus(seed, 240)
    index.add(chunk_table(spark, texts), batch="a")
    index.add(chunk_table(spark, texts[:50], 2), batch="b")
    r = random.Random(seed)
    asked = [(q, t) for q in range(12) for t in r.choices([f"w{i}" for i in range(60)] + ["none"], k=r.randint(1, 5))] + [(50, "w50"), (50, "w50"), (51, "w59"), (51, "w58"), (52, "none")]
    queries = spark.createDataFrame(asked, "qid long, term string")
    stats = index.bm25()
    full = {}
    for x in bm25.scores(stats, queries).collect():
        full.setdefault(x.qid, {})[x.id] = x.s
    k = 5
    search = blockmax.Search(index.read("blocks"), stats.terms, stats.corpus, queries)
    got = {}
    for x in search.top(k).collect():
        assert x.id not in got.setdefault(x.qid, {})
        got[x.qid][x.id] = x.s
    assert set(got) == set(full) and 52 not in got
    for q, scores in full.items():
        ranked = sorted(scores.values(), reverse=True)
        least = ranked[min(k, len(ranked)) - 1]
        want = {i: s for i, s in scores.items() if s >= least - 1e-9}
        assert want.keys() <= got[q].keys() and all(got[q][i] == pytest.approx(scores[i]) for i in got[q])
        assert all(s >= least - 1e-7 for s in got[q].values())
    read, total = search.read()
    assert 0 < read < total
    # the corpus's figures do not depend on how it is stored
    assert stats.corpus.first().n == len(texts) + 50
    index.merge()
    merged = {(x.qid, x.id): x.s for x in index.top(queries, k).collect()}
    assert merged.keys() == {(q, i) for q in got for i in got[q]}


def test_blocks_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "RANGE", 4)
    index = Index(spark, f"{tmp_path}/i")
    texts = corpus(3, 30)
    index.add(chunk_table(spark, texts, 1), batch="a")
    rows = index.read("blocks").collect()
    assert all(len(r.places) == r.n == len(r.tfs) == len(r.dls) and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) for r in rows)
    assert sum(r.n for r in rows if r.term == "") == len(texts) and all((r.ids is not None) == (r.term == "") for r in rows)
    ids = {x.chunk_id: (x.page_content or "").split() for x in index.read("chunks").collect()}
    got = {(x.id, x.term): (x.tf, x.dl) for x in blockmax.postings(index.read("blocks")).collect()}
    assert got == {(i, t): (w.count(t), len(w)) for i, w in ids.items() for t in w}


def test_few_ranges_are_read(spark, tmp_path):
    """A rare word beside a common one: most blocks of the common one are not read."""
    index = Index(spark, f"{tmp_path}/i")
    r = random.Random(5)
    texts = ["common " * r.randint(1, 3) + " ".join(f"x{r.randrange(9000)}" for _ in range(20)) for _ in range(6000)]
    for i in range(0, 1000, 100):
        texts[i] += " rare"
    index.add(chunk_table(spark, texts, 1), batch="a")
    stats = index.bm25()
    search = blockmax.Search(index.read("blocks"), stats.terms, stats.corpus, spark.createDataFrame([(0, "rare"), (0, "common")], "qid long, term string"))
    assert search.top(3).count() >= 3
    read, total = search.read()
    assert read <= 0.35 * total
    plan = index.chunks_of(spark.createDataFrame([("a/x",)], "id string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(chunk_id" in plan or "PushedFilters: [IsNotNull(chunk_id), EqualTo(chunk_id" in plan


def test_what_a_search_keeps_does_not_grow_with_questions_times_documents(spark, tmp_path, monkeypatch):
    """Of each range, a question keeps its k best alone, and runs come in order of terms without a sort by Spark."""
    monkeypatch.setattr(blockmax, "RANGE", 32)
    index = Index(spark, f"{tmp_path}/i")
    r = random.Random(7)
    index.add(chunk_table(spark, [" ".join(r.choices(["a", "b", "c", "d"], k=30)) for _ in range(640)], 1), batch="a")
    stats = index.bm25()
    search = blockmax.Search(index.read("blocks"), stats.terms, stats.corpus, spark.createDataFrame([(q, t) for q in range(6) for t in "abcd"], "qid long, term string"))
    kept = search.scores(search.bounds.withColumn("least", F.lit(None).cast("double")), 3).groupBy("qid", "range").count().collect()
    assert len(kept) == 6 * 20 and all(x["count"] <= 5 for x in kept)
    rows = index.read("blocks").select("term", "range").collect()
    assert rows == sorted(rows)
    assert "Sort" not in blockmax.blocks(index.read("chunks"))._jdf.queryExecution().executedPlan().toString()
