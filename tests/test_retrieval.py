import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import bm25, context, hybrid, knn


def okapi(docs, query):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    return [sum(idf[q] * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query if q in idf) for d in docs]


def test_bm25_against_plain_python(spark):
    r = random.Random(1)
    docs = [[r.choice("abcdefgh") for _ in range(r.randint(0, 12))] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    query = ["a", "b", "a", "zzz", "h"]
    q = spark.createDataFrame([(0, t) for t in query], "qid long, term string")
    got = {r.id: r.s for r in bm25.scores(bm25.build(df), q).collect()}
    for i, s in enumerate(okapi(docs, query)):
        assert got.get(i, 0.0) == pytest.approx(s, abs=1e-9)
    none = spark.createDataFrame([(0, "zzz")], "qid long, term string")
    assert bm25.scores(bm25.build(df), none).count() == 0


def fused(spark, texts, near, scores, k=5):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = spark.createDataFrame([(0, i, d, n + 1) for n, (i, d) in enumerate(near)], "qid long, id long, d2 double, rk int") if near is not None else None
    b = spark.createDataFrame([(0, i, s) for i, s in scores], "qid long, id long, s double") if scores is not None else None
    return hybrid.fuse(docs, hybrid.vector_leg(v) if v is not None else None, hybrid.bm25_leg(b, k) if b is not None else None, k).orderBy("rank").collect()


def test_fusion_rules(spark):
    texts = ["both", "copy", "copy", "far", "words", "words"]
    got = fused(spark, texts, [(0, 0.0), (1, 0.5), (2, 1.5), (3, 1.5000001)], [(0, 2.0), (4, 4.0), (5, 4.0), (3, -1.0)])
    score = {r.text: r.score for r in got}
    assert score["both"] == pytest.approx(0.7 + 0.15)
    assert score["copy"] == pytest.approx(0.7 / 2.5)  # the farther copy counts
    assert score["words"] == pytest.approx(0.6)  # every copy adds
    assert "far" not in score
    kept = {r.text: r.id for r in got}
    assert kept["copy"] == 2 and kept["words"] == 5  # larger id first among equal scores
    assert [r.text for r in got] == ["both", "words", "copy"]


def test_fusion_of_missing_legs_and_ties(spark):
    assert [r.text for r in fused(spark, ["a", "b"], None, [(0, 1.0), (1, 1.0)])] == ["b", "a"]
    assert [r.text for r in fused(spark, ["a", "b"], [(0, 1.0), (1, 1.0)], None)] == ["a", "b"]
    assert fused(spark, ["a"], None, [(0, 0.0)]) == [] and fused(spark, ["a"], None, None) == []


def test_knn(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    assert [(r.id, r.d2) for r in knn.nearest(v, q, 3).collect()] == [(0, 0.0), (1, 1.0), (2, 1.0)]
    qs = v.where("vec_id < 2").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    for block in (1000, 1):
        assert sorted((r.qid, r.id, r.rk) for r in knn.nearest_batch(v, qs, 2, block=block).collect()) == [(0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 2, 2)]
    plan = knn.nearest(v, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert knn.approximate(v.where("vec_id < 3"), [0.9, 0.0], 1).first().id == 1  # of two tied vectors, the smaller id


def test_knn_blocks_against_plain_python(spark):
    r = random.Random(9)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)] if i % 17 else [1.0]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    qs = spark.createDataFrame([(f"q{i}", [r.uniform(-2, 2) for _ in range(3)]) for i in range(40)] + [("none", None), ("short", [0.5])], "qid string, q array<double>")
    got = sorted((x.qid, x.rk, x.id) for x in knn.nearest_batch(v, qs, 4, block=15).collect())
    want = []
    for q in qs.collect():
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, q.q)), i) for i, x in rows if q.q is not None and len(x) == len(q.q))
        want += [(q.qid, n + 1, i) for n, (_, i) in enumerate(near[:4])]
    assert got == sorted(want)


def test_context_and_citations(spark):
    hits = spark.createDataFrame([(0, 1, "t1", "p"), (0, 2, "t2", None), (0, 3, "t3", "p"), (0, 4, "t4", "q.txt")], "qid long, rank int, text string, arxiv_id string")
    g = context.by_source(hits)
    assert context.contexts(g).first().context == "t1\nt3\n\n---\n\nt2\n\n---\n\nt4"
    titles = spark.createDataFrame([("p", "x" * 81), ("q", None)], "arxiv_id string, title string")
    lines = [r.line for r in context.citations(g, titles).orderBy("number").collect()]
    assert lines == [f"1. [p] {'x' * 77}...", "2. [unknown] unknown", "3. [q.txt] q.txt"]


def test_history_and_answers(spark):
    turns = [(0, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(14)] + [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "user", "v"), (1, 3, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = [(r.conv_id, r.pair, r.user, r.assistant) for r in context.history_pairs(df).orderBy("conv_id", "pair").collect()]
    assert got == [(0, i + 1, f"t{2 * i + 4}", f"t{2 * i + 5}") for i in range(5)] + [(1, 1, "v", "a")]
    q = spark.createDataFrame([(0, "what is cat", [("u1", "a1")] * 6), (1, "none", None)], "qid long, question string, history array<struct<u:string,a:string>>")
    m = {r.qid: r.m for r in q.select("qid", context.messages(F.lit(None).cast("string"), F.col("history"), F.col("question")).alias("m")).collect()}
    assert len(m[0]) == 12 and m[0][0].role == "system" and m[0][-1].content == "what is cat" and len(m[1]) == 2
    hits = spark.createDataFrame([(0, 1, "A dog. The cat is here", "p")], "qid long, rank int, text string, arxiv_id string")
    out = {r.qid: r.answer for r in context.answers(q, hits, spark.createDataFrame([("p", "T")], "arxiv_id string, title string")).collect()}
    assert out[0] == "The cat is here\n\n---\n📚 参考来源：\n1. [p] T" and out[1] == context.NO_CONTEXT


def test_the_title_of_an_id_does_not_depend_on_the_order_of_rows(spark):
    g = spark.createDataFrame([(0, "a.txt", 1)], "qid long, source string, first int")
    rows = [(7, "a", "third"), (5, "a", "second"), (3, "a", "first"), (1, "a", None)]
    for r in (rows, rows[::-1], rows[2:] + rows[:2]):
        titles = spark.createDataFrame(r, "id long, arxiv_id string, title string")
        assert [x.line for x in context.citations(g, titles).collect()] == ["1. [a.txt] first"]


def test_the_best_documents_are_those_of_all_scores(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["a", "b", "c", "dd", "e", "f1", "g"]) for _ in range(r.randint(0, 20))) if i % 50 else None) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(20)]  # copies: equal scores
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = [(q, t) for q in range(9) for t in r.choices(["a", "b", "c", "dd", "e", "f1", "zzz"], k=q + 1)]
    queries, index = spark.createDataFrame(asked, "qid long, term string"), bm25.build(df)
    want = {}
    for x in bm25.scores(index, queries).where("s > 0").collect():
        want.setdefault(x.qid, []).append((-round(x.s, 9), -x.id))
    for block in (256, 2):
        got = {}
        for x in bm25.best(index, queries, 10, block=block).collect():
            got.setdefault(x.qid, []).append((-round(x.s, 9), -x.id))
        assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in sorted(v)[:10]] for q, v in want.items()}
    assert bm25.best(index, queries.where("term = 'zzz'"), 10).count() == 0


def test_titles_that_are_not_cited_are_not_shuffled(spark):
    g = spark.createDataFrame([(0, "a.txt", 1)], "qid long, source string, first int")
    titles = spark.range(1000).selectExpr("cast(id as string) as arxiv_id", "id", "'t' as title")
    plan = context.citations(g, titles)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
