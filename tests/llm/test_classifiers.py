import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import langid, quality

WORDS = {"aa": "tion ing the and of er".split(), "bb": "que les é ou aux ment".split(), "cc": "ung sch ö keit ein der".split()}


def text(r, lang, n=40):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages(spark, odd, none):
    r = random.Random(1)
    rows = [(i, text(r, lang), lang) for i in range(150) for lang in [r.choice(list(WORDS))]]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "x", None), (902, "123", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out("doc_id", 4, 2)))
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.languages(df, model).where(langid.held_out("doc_id", 4, 2) & (F.col("doc_id") < 900)).collect()
    assert sum(x.lang_pred == x.lang for x in got) >= 0.95 * len(got) and all(0 <= x.score <= 1 for x in got)
    out = {x.doc_id: x for x in langid.languages(odd, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 4, 8)) and out[7].lang_pred != "und"
    assert langid.fit(df.limit(0)) is None and {x.lang_pred for x in langid.languages(odd, None).collect()} == {"und"}
    assert langid.languages(none, model).count() == 0
    kept = langid.known_languages(df)
    assert kept.columns == df.columns and kept.where("doc_id < 900").count() == 150 and kept.where("doc_id in (900, 902)").count() == 0


def test_presence_kernel():
    s = langid.Settings(orders=(1, 2))
    assert set(langid.grams("ab ab", s)) == set(langid.grams("AB ab ab!", s)) != set(langid.grams("ba", s))


def test_remainders(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out("doc_id", 4, 2).alias("h")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(50)) and got[None] is False


def test_letters(spark):
    assert [langid.has_letter(t) for t in (None, "", "½ ² Ⅷ 12", "½ é", "日", "ª", "a", "_!")] == [False, False, False, True, True, True, True, False]
    df = spark.createDataFrame([(1, "½ ²", "aa"), (2, "some words", "bb"), (2, "some words", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.langs == ["bb"] and [r.lang_pred for r in langid.languages(df, model).orderBy("doc_id").collect()] == ["und", "bb", "bb"]


def test_kernel_ridge_against_the_exact_solution():
    r = random.Random(7)
    langs = [lang for lang in WORDS for _ in range(12)]
    texts = [text(r, lang, 9) for lang in langs]
    s = langid.Settings(landmarks=36)
    found = [langid.grams(t, s) for t in texts]
    model = langid.Model(found, langs, s)
    kernel = lambda a, b: np.array([[len(set(x) & set(y)) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    n, k, w = len(texts), kernel(found, found), np.array([1 / 12] * 36) * 36 / 3
    y = np.array([[1.0 if a == b else -1.0 for b in model.langs] for a in langs])
    system = np.block([[w[:, None] * k + s.ridge * n * np.eye(n), w[:, None]], [(w @ k)[None, :], np.array([[w.sum()]])]])
    solution = np.linalg.solve(system, np.vstack([w[:, None] * y, (w @ y)[None, :]]))
    others = [langid.grams(text(r, lang, 9), s) for lang in WORDS for _ in range(5)]
    exact = kernel(others, found) @ solution[:-1] + solution[-1]
    own = model._features(others).astype(float) @ model.beta[:-1] + model.beta[-1]
    assert np.abs(own - exact).max() < 1e-3


def test_gradients():
    r = np.random.default_rng(1)
    bags = [r.normal(size=(k, 6)) for k in (1, 3, 2)]
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    m = quality.Model.fit(bags, y, quality.Settings(epochs=2, hidden=5, gate=3))

    def loss():
        p = m._forward(x, starts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, grad in zip(range(len(m.weights)), m.gradients(x, starts, y), strict=True):
        for at in np.ndindex(m.weights[w].shape):
            kept, ends = np.array(m.weights[w]), []
            for step in (1e-5, -1e-5):
                moved = kept.copy()
                moved[at] += step
                m.weights[w] = moved
                ends.append(loss())
            m.weights[w] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-6


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, "same words here"), (1, "same words here")] * 200 + [(2, "x" * 9000)] + [(i, f"words {i}") for i in range(3, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    seen = []
    fit = quality.Model.fit
    quality.Model.fit = classmethod(lambda cls, bags, y, s: seen.append([len(b) for b in bags]))
    try:
        quality.fit(docs, labels, settings=quality.Settings(longest=10))
        quality.fit(docs, labels, settings=quality.Settings(longest=10, total=100))
    finally:
        quality.Model.fit = fit
    assert len(seen[0]) == 457 and max(seen[0]) == 1 and sum(seen[1]) < 457


def test_quality(spark, odd, none):
    r = random.Random(2)
    rows = []
    for i in range(200):
        t = text(r, "aa", r.randint(30, 300))
        rows.append((i, t.upper().replace(" ", "!! ") if i % 3 == 0 else t, int(i % 3 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    model = quality.fit(docs, labels.where(~langid.held_out("doc_id", 3, 1)))
    got = quality.scored(docs, model).where(langid.held_out("doc_id", 3, 1)).collect()
    assert sum(x.predicted == x.quality for x in got) >= 0.95 * len(got)
    out = quality.scored(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    assert quality.fit(docs, labels.limit(0)) is None and quality.scored(odd, None).first().score == 0.5
    assert quality.scored(none, model).count() == 0
