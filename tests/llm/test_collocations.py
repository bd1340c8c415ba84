import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(docs, s):
    """By nested loops over all texts; docs: lang, text."""
    f, n = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, s.most + 1) for i in range(len(w) - k + 1))
    rows = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= s.least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= s.cover * a for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        rows += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(scored)[: s.top])]
    return sorted(rows)


def texts(seed, n=60, size=60):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "times", "é", "Éa", "a", "x-y", "\x1c", "　w"] + [f"w{i}" for i in range(40)]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    joins = [" "] * 30 + [", ", ".", "\n", "\t", "  ", "; ", " \r"]
    return [(r.choice(["en", "en", "fr", None]), "".join(w + r.choice(joins) for w in r.choices(vocabulary, odds, k=r.randint(0, size)))) for _ in range(n)]


@pytest.mark.parametrize("s", [C.Settings(least=4), C.Settings(least=3, cover=70, top=15, buckets=7), C.Settings(least=4, route=10, buckets=64), C.Settings(most=3, least=5, route=1)])
def test_equals_brute_force(spark, s):
    docs = texts(s.buckets + s.most) + [("en", "new york times " * 9), ("en", "a a a a a a. a a a"), ("en", None), (None, ""), ("a\t%09%b", "one two " * 6)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    got = C.collocations(df, s)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(docs, s)


def test_query(spark, tmp_path):
    docs = texts(11, 300, 200)
    spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = C.op12_query(spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == COLUMNS and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert rows and rows == brute(docs, C.Settings())


def test_exact_products(spark):
    a, n, l, r = 987_654_321_987, 999_999_999_999_999, 987_654_322_000, 998_765_432_101
    one = spark.sql(f"SELECT cast(1000 * cast({a} as decimal(18, 0)) as decimal(22, 0)) * cast({n} as decimal(15, 0)) div (cast({l} as decimal(18, 0)) * cast({r} as decimal(18, 0))) AS s")
    assert one.first().s == 1000 * a * n // (l * r)


def test_surroundings():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40):
        key = r.integers(0, 5, n).astype(np.int32)
        left, right = C.surroundings(key, 4)
        for i in range(n):
            x = y = 0
            while key[i] and x < 4 and i - x - 1 >= 0 and key[i - x - 1] > key[i]:
                x += 1
            while key[i] and y < 4 and i + y + 1 < n and key[i + y + 1] >= key[i]:
                y += 1
            assert (left[i], right[i]) == (x, y)


def test_grouping_survives_equal_hashes(monkeypatch):
    rows = np.array([[1, 2], [3, 4], [1, 2], [-1, 0]])
    at, sums = C.grouped(rows, np.array([1, 10, 100, 1000]))
    assert {tuple(rows[i]): int(s) for i, s in zip(at, sums)} == {(1, 2): 101, (3, 4): 10, (-1, 0): 1000}
    assert len(C.grouped(np.zeros((0, 3), int), np.zeros(0, int))[0]) == 0


def test_odd_rows(spark, odd, none):
    s = C.Settings(least=3)
    docs = odd.withColumn("lang", F.when(F.col("doc_id") < 6, "x")).withColumn("rank", F.lit(1))
    want = brute([(r.lang, r.text) for r in docs.collect()], s)
    assert want and sorted(map(tuple, C.collocations(docs, s).collect())) == want
    assert C.collocations(none.withColumn("lang", F.lit("x")), s).count() == 0
