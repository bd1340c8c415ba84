import random

import numpy as np
import pytest

from lorekeep.config import Settings
from lorekeep.engine import Engine
from lorekeep.functions.embed import hashing_embedder
from lorekeep.operators import embedding as E


def corpus(seed, n, topics=8, own=60):
    """Texts of a few topics: each takes words of its topic, among words that all share."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = i % topics
        out.append((k, " ".join(f"t{k}w{int(r.random() ** 2 * own)}" if r.random() < 0.6 else f"all{int(r.random() ** 2 * 60)}" for _ in range(40))))
    return out


def same_topic(embed, rows):
    """How often the nearest second half of another text is of the topic of a first half."""
    first = embed([t[: len(t) // 2] for _, t in rows])
    second = embed([t[len(t) // 2 :] for _, t in rows])
    near = first @ second.T
    np.fill_diagonal(near, -9)
    return np.mean([rows[i][0] == rows[j][0] for i, j in enumerate(near.argmax(axis=1))])


def test_learned_vectors_beat_hashing(spark, tmp_path):
    docs = spark.createDataFrame([(t,) for _, t in corpus(1, 400)] + [(None,), ("",), ("unseen",)], "text string").repartition(4)
    learned = E.learn(docs, learning=E.Learning(dim=24))
    held_out = corpus(2, 160)
    ours, hashed = same_topic(learned, held_out), same_topic(hashing_embedder(24), held_out)
    assert ours > 0.9 > hashed + 0.1, (ours, hashed)
    v = learned(["t0w1 t0w2", "", "nothing known", None])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 0, 0], atol=1e-5)
    E.save(spark, learned, f"{tmp_path}/e")
    again = E.load(spark, f"{tmp_path}/e")
    texts = [t for _, t in held_out[:20]]
    assert np.allclose(again(texts), learned(texts), atol=1e-6) and E.load(spark, f"{tmp_path}/none") is None


def test_near_counts_and_decomposition_against_dense_ones(spark):
    texts = [t for _, t in corpus(3, 30, topics=3, own=6)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    words = sorted({w for t in texts for w in t.split()})[:-1]  # one word is not on the list, and keeps its place
    place, n = {w: i for i, w in enumerate(words)}, np.zeros((len(words), len(words)))
    for t in texts:
        w = t.split()
        for a in range(len(w)):
            for b in range(max(0, a - 2), min(len(w), a + 3)):
                if a != b and w[a] in place and w[b] in place:
                    n[place[w[a]], place[w[b]]] += 1
    rows = E.near_counts(docs, words, 2).repartition("i").sortWithinPartitions("i")
    assert {(r.i, r.j): r.n for r in rows.collect()} == {(i, j): n[i, j] for i, j in zip(*np.nonzero(n))}
    sums = n.sum(axis=1)
    with np.errstate(divide="ignore"):
        dense = np.maximum(0, np.log(n * n.sum() / np.outer(sums, sums)))
    m = E.Associations(rows, len(words))
    block = np.random.default_rng(0).normal(size=(len(words), 4))
    assert np.allclose(m.times(block), dense @ block)
    u, s = m.leading(5, 10, 6)
    want_u, want_s, _ = np.linalg.svd(dense)
    assert np.allclose(s[:3], want_s[:3], rtol=5e-3) and np.allclose(np.abs(np.sum(u[:, :1] * want_u[:, :1])), 1, atol=1e-3)


def test_nothing_to_learn(spark):
    none = E.learn(spark.createDataFrame([(None,), ("once",)], "text string"))
    assert np.allclose(none(["once", "x"]), 0) and none(["a"]).shape == (1, 64)


def test_engine_keeps_its_embedder(spark, tmp_path):
    e = Engine(spark, Settings(index_dir=f"{tmp_path}/index", database="embdb", embedding_dim=24, chunk_size=2000))
    rows = corpus(1, 200)
    e.fit_embedder(spark.createDataFrame([(t,) for _, t in rows], "text string"))
    (tmp_path / "in").mkdir()
    for i, (k, t) in enumerate(rows[:16]):
        (tmp_path / "in" / f"{k}-{i}.txt").write_text(t, encoding="utf-8")
    again = Engine(spark, e.settings)
    assert again.upload(f"file://{tmp_path}/in") == 16
    asked = spark.createDataFrame([(k, t) for k, t in corpus(9, 8)], "qid long, question string")
    best = {r.qid: r.source for r in again.hybrid_search(asked, k=1, bm25_weight=0.0).collect() if r.rank == 1}
    assert sum(f"/{k}-" in s for k, s in best.items()) >= 6
    with pytest.raises(ValueError):
        again.fit_embedder(asked, "question")
    spark.sql("DROP DATABASE embdb CASCADE")
