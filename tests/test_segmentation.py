import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.config import Settings
from lorekeep.engine import Engine
from lorekeep.functions import segment
from lorekeep.operators import segmentation as S


def every_path(lexicon, run):
    for n in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), n):
            ends = [*cuts, len(run)]
            words = [run[a:b] for a, b in zip([0, *cuts], ends)]
            if all(w in lexicon.costs or len(w) == 1 for w in words):
                yield sum(lexicon.costs.get(w, lexicon.floor) for w in words), [a for a in reversed([0, *cuts])], words


def test_paths_are_the_cheapest_of_all():
    r = random.Random(3)
    for _ in range(60):
        words = {"".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 4))): r.choice([1, 1, 2, 5, 40]) for _ in range(r.randint(0, 12))}
        lexicon = segment.Lexicon.of(words)
        for _ in range(10):
            run = "".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(1, 9)))
            assert lexicon.path(run) == min(every_path(lexicon, run))[2]
    assert segment.Lexicon.of({}).path("") == [] and segment.Lexicon.of({"": 3, "甲": 0}).path("甲乙") == ["甲", "乙"]


def test_tags_are_the_likeliest_of_all():
    r = random.Random(5)
    for _ in range(25):
        tags = {(t, c): r.randint(0, 9) for t in "BMES" for c in "甲乙丙"}
        h = segment.Hmm.of({k: n for k, n in tags.items() if n}, {(a, b): r.randint(0, 9) for a, after in segment._AFTER.items() for b in after}, {"B": r.randint(0, 9), "S": r.randint(0, 9)})
        run = "".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 6)))

        def cost(ts):
            own = h.start.get(ts[0], float("inf")) + sum(h._emit(t, c) for t, c in zip(ts, run))
            return own + sum(h.moves.get(a + b, float("inf")) for a, b in zip(ts, ts[1:])) + (0 if ts[-1] in "ES" else float("inf"))

        best = min(cost(ts) for ts in itertools.product("BMES", repeat=len(run)))
        got = h.tags(run)
        assert cost(got) == pytest.approx(best) and "".join(h.words(run)) == run


VOCABULARY = ["机器", "学习", "语言", "模型", "检索", "系统", "人工智能", "数据库", "图书馆", "我们", "的", "在", "用", "了", "很"]


def corpus(n=400, seed=7):
    r = random.Random(seed)
    out, borders = [], []
    for _ in range(n):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(3, 12))]
        out.append("".join(words) + r.choice(["。", "，x ", ""]))
        borders.append(words)
    return out, borders


def spans(words):
    ends = list(itertools.accumulate(map(len, words)))
    return set(zip([0, *ends[:-1]], ends))


def test_learned_words_give_the_borders_back(spark):
    texts, _ = corpus()
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("no script at all",)], "text string").repartition(3)
    lexicon = S.learn(docs, learning=S.Learning(least=10))
    assert {w for w in VOCABULARY if len(w) > 1} <= set(lexicon.costs)
    unseen, borders = corpus(100, 8)
    right = found = true = 0
    for t, words in zip(unseen, borders):
        got, want = spans(lexicon.words("".join(words))), spans(words)
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert 2 * right / (found + true) > 0.9
    # what the lexicon does not know is left to the model, and nothing is lost
    assert "".join(lexicon.words("龘龘机器龖龗")) == "龘龘机器龖龗"


def test_word_table_against_plain_python(spark):
    import math
    from collections import Counter

    texts, _ = corpus(60, 2)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    learning = S.Learning(least=4, longest=3)
    found = S.grams(docs, 3)
    rows = {r.gram: r for r in S.word_table(found, learning).collect()}
    import re

    runs = [m for t in texts for m in re.findall(segment.HAN, t)]
    n, sides = Counter(), {}
    for run in runs:
        for k in (1, 2, 3):
            for i in range(len(run) - k + 1):
                g = run[i : i + k]
                n[g] += 1
                for side, c in ((0, run[i - 1] if i else None), (1, run[i + k] if i + k < len(run) else None)):
                    sides.setdefault((g, side), Counter())[c] += 1
    total = sum(c for g, c in n.items() if len(g) == 1)
    assert set(rows) == {g for g, c in n.items() if len(g) == 1 or c >= 4}
    for g, r in rows.items():
        assert r.n == n[g]
        if len(g) > 1:
            assert r.cohesion == pytest.approx(min(math.log(n[g] * total / (n[g[:k]] * n[g[k:]])) for k in range(1, len(g))))
            entropy = [sum(c * (math.log(n[g]) - (math.log(c) if x else 0)) for x, c in sides[g, s].items()) / n[g] for s in (0, 1)]
            assert r.freedom == pytest.approx(min(entropy), abs=1e-9)


def test_bounds_and_storage(spark, tmp_path):
    counts = spark.createDataFrame([(f"w{i}", i) for i in range(1, 101)], "gram string, n long")
    kept = [r.n for r in S.most_frequent(counts, 10).collect()]
    assert 0 < len(kept) <= 10 and min(kept) == 101 - len(kept)
    assert S.most_frequent(counts, 0).count() == 0 and S.most_frequent(counts, 1000).count() == 100
    docs = spark.createDataFrame([(t,) for t in corpus(80)[0]], "text string")
    lexicon = S.learn(docs, learning=S.Learning(words=20))
    assert 0 < len(lexicon.costs) <= 20
    S.save(spark, lexicon, f"{tmp_path}/lexicon")
    assert S.load(spark, f"{tmp_path}/lexicon") == lexicon and S.load(spark, f"{tmp_path}/none") is None
    assert S.learn(docs.limit(0)).words("机器") == ["机", "器"]


def test_engine_searches_chinese_words(spark, tmp_path):
    e = Engine(spark, Settings(index_dir=f"{tmp_path}/index", database="segdb", tokens="words", chunk_size=50, chunk_overlap=0))
    texts, _ = corpus()
    lexicon = e.fit_segmenter(spark.createDataFrame([(t,) for t in texts], "text string"), learning=S.Learning(least=10))
    (tmp_path / "in").mkdir()
    for i, t in enumerate(["我们用数据库", "图书馆的系统", "机器学习 and BM25"]):
        (tmp_path / "in" / f"{i}.txt").write_text(t, encoding="utf-8")
    assert e.upload(f"file://{tmp_path}/in") == 3
    again = Engine(spark, e.settings)  # the lexicon lies beside the index
    assert {r.term for r in again.index.read("blocks").select("term").distinct().collect()} >= {"数据库", "图书馆", "BM25", "and"}
    asked = spark.createDataFrame([(0, "数据库"), (1, "学习BM25")], "qid long, question string")
    best = {(r.qid, r.rank): r.text for r in again.hybrid_search(asked, vector_weight=0.0).collect()}
    assert best[0, 1] == "我们用数据库" and best[1, 1] == "机器学习 and BM25"
    assert lexicon.tokens("我们x数据库。BM25") == ["我们", "x", "数据库", "BM25"]
    with pytest.raises(ValueError):
        again.fit_segmenter(asked, "question")
    spark.sql("DROP DATABASE segdb CASCADE")


def test_columns(spark):
    lexicon = segment.Lexicon.of({"甲乙": 5, "丙": 1})
    rows = spark.createDataFrame([("甲乙丙 x",), (None,), ("",)], "t string").select(segment.applied(F.col("t"), lexicon).alias("w")).collect()
    assert [r.w for r in rows] == [["甲乙", "丙", "x"], None, []]
