import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import neural_lm as L

SMALL = L.Settings(words=40, classes=5, hidden=6, window=5, lanes=7, segment=11, rounds=2, listed=60, group=500)


def small_net(n=11, dtype=np.float64, seed=3):
    s = L.Settings(hidden=5, classes=3, window=4)
    net = L.Network(n, s)
    r = np.random.default_rng(seed)
    return L.Network(n, s, r.normal(0, 0.5, len(net.flat)).astype(dtype))


def step(net, before, h):
    """One step of one lane, written out."""
    p, n = net.p, net.h
    h = h * (before != 0)
    a, s = p["e"][before] @ p["w"] + p["b"], h @ p["u"]
    sig = lambda x: 1 / (1 + np.exp(-x))
    z, r = sig(a[:n] + s[:n]), sig(a[n : 2 * n] + s[n : 2 * n])
    m = np.tanh(a[2 * n :] + r * s[2 * n :])
    return (1 - z) * m + z * h


def distribution(net, h):
    """log probabilities of all tokens."""
    p = net.p
    c = h @ p["c"] + p["cb"]
    c = c - np.log(np.exp(c).sum())
    out = []
    for k, (lo, hi) in enumerate(zip(net.edges, net.edges[1:])):
        w = p["o"][lo:hi] @ h + p["ob"][lo:hi]
        out += (c[k] + w - np.log(np.exp(w).sum())).tolist()
    return np.array(out)


def plain_score(net, tokens):
    h, before, total = np.zeros(net.h), 0, 0.0
    for t in tokens:
        h = step(net, before, h)
        total += distribution(net, h)[t]
        before = t
    return total / np.log(10)


def test_probabilities_add_up_to_one():
    net = small_net()
    h = np.random.default_rng(1).normal(0, 1, 5)
    assert np.exp(distribution(net, h)).sum() == pytest.approx(1)
    got = net.log_probs(np.tile(h, (12, 1)), np.arange(12))
    assert np.allclose(got, distribution(net, h))


def test_state_is_carried_over_whole_documents():
    net, r = small_net(), random.Random(4)
    docs = [np.array([r.randint(1, 11) for _ in range(r.choice([0, 1, 3, 9, 40]))] + [0], np.uint16) for _ in range(30)]
    want = [plain_score(net, d.tolist()) for d in docs]
    for lanes in (1, 4, 100):
        assert np.allclose(L.log10_scores(net, docs, lanes), want)
    assert len(L.log10_scores(net, [])) == 0


def test_gradients_are_those_of_differences():
    net, r = small_net(), np.random.default_rng(5)
    before, targets = r.integers(0, 12, (4, 3)), r.integers(0, 12, (4, 3))
    weight, h = r.random((4, 3)), r.normal(0, 1, (5, 3))

    def loss(flat):
        own = L.Network(net.n, net.settings, flat)
        return -(own.log_probs(own.states(before, h).reshape(5, -1).T, targets.ravel()) * weight.ravel()).sum()

    grad, last, value = net.gradients(before, targets, weight, h)
    assert value == pytest.approx(loss(net.flat)) and np.allclose(last, net.states(before, h)[:, -1])
    for i in r.choice(len(net.flat), 120, replace=False):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert grad[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-4, abs=1e-7)


def test_lanes_hold_every_token_once():
    r = random.Random(6)
    for _ in range(20):
        docs = [np.arange(r.randint(1, 30)) + 100 * i for i in range(r.randint(1, 12))]
        own = L.laid_out(docs, r.randint(1, 6))
        seen = np.concatenate([at[valid] for at, _, valid in L.windows(own, r.randint(1, 9))])
        assert sorted(seen.tolist()) == list(range(len(own.tokens)))
        assert sorted(own.tokens.tolist()) == sorted(x for d in docs for x in d.tolist())


ODD_TEXTS = ["", None, " ", "One two  one", "\x1c É\x0bé\x00 rare1\n", "\t\ntwo two THREE four\r", "x\x85y\u2003z", "w " * 70 + "two"]


def test_flat_words_are_those_of_each_text():
    for column in (pa.array(ODD_TEXTS), pa.array(ODD_TEXTS).slice(2, 4), pa.array([None], pa.string())):
        found, starts = L._flat_words(column)
        own = found.to_pylist()
        got = [[w.encode() for w in own[i:j] if w] for i, j in zip(starts[:-1], starts[1:], strict=True)]
        assert got == [L.words((t or "").encode()) for t in column.to_pylist()]
    raw = [b"\xff A\xfe Bc", None, b"\xc3", b"a\x00B\x85 c"]  # not UTF-8
    for column in (pa.array(raw), pa.array(raw).view(pa.string()), pa.array(raw).cast(pa.large_binary())):
        found, starts = L._flat_words(column)
        own = found.cast(pa.binary()).to_pylist()
        assert [[w for w in own[i:j] if w] for i, j in zip(starts[:-1], starts[1:], strict=True)] == [L.words(t or b"") for t in raw]


def test_encoding_hashes_each_word_once_for_all_texts(monkeypatch):
    digest, hashed = L.xxhash.xxh3_128_digest, Counter()
    monkeypatch.setattr(L, "xxhash", type("Counting", (), {"xxh3_128_digest": staticmethod(lambda w: hashed.update([w]) or digest(w))}))
    texts = ODD_TEXTS * 40
    listed = [b"", *(digest(w) for w in (b"two", b"w", b"one"))]
    counts, known = np.array([9, 7, 5, 0, 0]), 2
    got = L._encoded_texts(pa.array(texts), {w: i for i, w in enumerate(listed)}, counts, known)
    assert set(hashed.values()) == {1} and set(hashed) == {w for t in texts for w in L.words((t or "").encode())}
    for t, *row in zip(texts, *(x.to_pylist() for x in got), strict=True):
        own = [*L.words((t or "").encode()), b""]
        at = [listed.index(digest(w) if w else w) if (digest(w) if w else w) in listed else 4 for w in own]
        assert row[:3] == [len(own), sum(counts[i] > 0 for i in at), sum(i >= known for i in at)]
        assert row[3:5] == pytest.approx([np.log10(counts[at] + 1).sum(), np.log10(counts[[i for i in at if i >= known]] + 1).sum() if max(at) >= known else 0])
        assert np.frombuffer(row[5], np.uint16).tolist() == [min(i, known) for i in at]
        assert {o["word"]: o["k"] for o in row[6]} == Counter(digest(w) for w, i in zip(own, at, strict=True) if i == 4)


def test_large_weights_neither_run_over_nor_vanish():
    net, r = small_net(), np.random.default_rng(9)
    h = r.normal(0, 1, (6, 5))
    for scale in (3, 30, 60):  # the last two add biases and take off the largest logit
        own = L.Network(net.n, net.settings, (net.flat * scale).astype(np.float32))
        want = L.Network(net.n, net.settings, own.flat.astype(np.float64))
        for x in h:
            got = own.log_probs(np.tile(x, (12, 1)).astype(np.float32), np.arange(12))
            assert np.isfinite(got).all() and np.allclose(got, distribution(want, x), rtol=1e-4, atol=1e-3)
        grads = {k: np.zeros_like(v) for k, v in own.p.items()}
        own.log_probs(h.astype(np.float32), np.arange(6), (np.ones(6, np.float32), grads))
        exact = {k: np.zeros_like(v) for k, v in want.p.items()}
        want.log_probs(h, np.arange(6), (np.ones(6), exact))
        assert all(np.isfinite(grads[k]).all() and np.allclose(grads[k], exact[k], rtol=1e-3, atol=1e-3 * scale) for k in ("c", "cb", "o", "ob", "states"))


def corpus(n=300, seed=8):
    """Sentences in which a word tells much of the next one; some words are rare."""
    r = random.Random(seed)
    after = {i: [(i * 7 + k) % 30 for k in range(3)] for i in range(30)}
    out = []
    for d in range(n):
        w, own = r.randrange(30), []
        for _ in range(r.randint(0, 60)):
            w = r.choice(after[w])
            own.append(f"Word{w}" if r.random() < 0.95 else f"rare{r.randrange(4000)}")
        out.append((d, " ".join(own)))
    return out


def base_rows(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by plain counting."""
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() + [b""]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not out_of(i) for w in fold(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        w = fold(t)
        yield i, out_of(i), len(w), sum(c[x] > 0 for x in w), n, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)


@pytest.mark.parametrize("settings", [None, SMALL])
def test_query_and_its_scores(spark, tmp_path, monkeypatch, settings):
    docs = [*corpus(), (900, None), (901, ""), (902, "\x1c É\x0bé\x00 rare1"), (3, "again"), (None, "no id Word1 Word2")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    nets, vocabs, fit, read = [], [], L.fitted, L.vocabulary
    monkeypatch.setattr(L, "fitted", lambda *a: nets.append(fit(*a)) or nets[-1])
    monkeypatch.setattr(L, "vocabulary", lambda *a: vocabs.append(read(*a)) or vocabs[-1])
    if settings:
        monkeypatch.setattr(L.scored, "__defaults__", ("text", settings))
    got = L.op11_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = sorted(map(tuple, got.collect()), key=str)
    want = sorted(base_rows(docs), key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want] and np.allclose([r[5] for r in rows], [w[5] for w in want])
    # the whole model, token by token
    net, vocab = nets[0], vocabs[0]
    counts = {bytes(w): c for w, (_, c) in vocab.counts.items()}
    every = Counter(w for i, t in docs if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for w in [*L.words((t or "").encode()), b""])
    digest = lambda w: L.xxhash.xxh3_128_digest(w) if w else b""
    assert len(counts) <= (settings or L.Settings()).listed + 1 and all(every[w] == counts[digest(w)] for w in every if digest(w) in counts)
    rare_n, rare_v = vocab.rare
    by_key = {(r[0], r[2], round(r[5], 9)): r[6] for r in rows}
    for (i, t), b in zip(docs, base_rows(docs), strict=True):
        own = [*L.words((t or "").encode()), b""]
        ids = [min(vocab.counts.get(digest(w), (vocab.known, 0))[0], vocab.known) for w in own]
        rest = sum(np.log10((every[w] + 1) / (rare_n + rare_v + 1)) for w, k in zip(own, ids, strict=True) if k == vocab.known)
        assert by_key[(i, b[2], round(b[5], 9))] == pytest.approx(plain_score(net, ids) + rest, rel=1e-4, abs=1e-3)


def test_learning_beats_counts(spark):
    docs = spark.createDataFrame(corpus(900), "doc_id long, text string")
    s = L.Settings(words=64, classes=8, hidden=16, window=10, lanes=16, rounds=3, rate=0.03)
    rows = L.scored(docs, ~L.held_out("doc_id", 7, 2), settings=s).where(L.held_out("doc_id", 7, 2)).agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert rows[2] / rows[0] > rows[1] / rows[0] + 0.15  # log10 a token


def test_odd_rows(spark, odd, none):
    for docs in (odd, odd.withColumnRenamed("found_", "ids").withColumn("word", F.lit(1))):
        got = L.scored(docs, F.col("doc_id") != 3, settings=SMALL)
        assert [c for c in got.columns if c in docs.columns] == [c for c in docs.columns if c not in ("text", "n_tokens", "score")] + ["n_tokens", "score"]
        rows = {(r.doc_id, r.n_tokens, r.score) for r in got.collect()}
        assert got.count() == docs.count() and {(1, 1), (2, 1), (3, 2)} <= {r[:2] for r in rows} and len({r for r in rows if r[0] == 5}) == 1
    assert L.scored(none, F.lit(True), settings=SMALL).count() == 0
    untrained = L.scored(odd, F.lit(False), settings=SMALL).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in untrained} == {(0, 0.0, 0)} and all(np.isfinite(r.score) for r in untrained)
