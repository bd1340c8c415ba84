"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, bounded_sample, table
from .langid import held_out


@dataclass(frozen=True)
class Settings:
    """rows: labelled documents that the model is fitted on, about; total, longest: passages of all these documents, about,
    and of one of them, at most (longer ones are scored whole, but not learned from); passage: bytes of a passage; hidden,
    gate: sizes of the encoding and of the attention; epochs, batch, rate, decay: training."""

    rows: int = 5_000
    total: int = 100_000
    longest: int = 5_000
    passage: int = 600
    hidden: int = 24
    gate: int = 12
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4


#: Kinds of bytes: what stands next to what describes a passage's form without its words.
_KINDS = 13
_KIND = np.full(256, 12, np.uint8)
for _i, _group in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".?", ",;:", "!", "|/\\", "#$%&*+=<>^~_@", "'\"()[]{}-`"]):
    for _c in _group:
        _KIND[ord(_c)] = _i
_KIND[128:] = 11
FEATURES = _KINDS * _KINDS + 5


def passages(text: str | None, size: int) -> np.ndarray:
    """A row of features for each passage of the whole text; an empty text is one passage of zeros."""
    b = text.encode() if text else b""
    if not b:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(b) // size)
    kinds = _KIND[np.frombuffer(b, np.uint8)].astype(np.int32)
    out = np.zeros((n, FEATURES), np.float32)
    pairs = kinds[:-1] * _KINDS + kinds[1:] if len(kinds) > 1 else np.zeros(0, np.int32)
    counts = np.bincount((np.arange(len(pairs)) // size) * (_KINDS * _KINDS) + pairs, minlength=n * _KINDS * _KINDS).reshape(n, -1)
    out[:, : _KINDS * _KINDS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    for i in range(n):
        ws = b[i * size : (i + 1) * size].split()
        if ws:
            different = len(set(ws))
            same = sum(x == y for x, y in zip(ws, ws[1:], strict=False))
            out[i, -5:] = different / len(ws), different / len(ws) ** 0.5 / 10, same / len(ws), sum(map(len, ws)) / len(ws) / 10, len(ws) / 100
    return out


class Model:
    """Encodes passages, weighs them by gated attention, and scores the weighted mean of their encodings."""

    def __init__(self, s: Settings, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.s, self.mean, self.scale, self.weights = s, mean, scale, weights

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        w1, b1, v, u, a, c, b = self.weights
        h = np.tanh(x @ w1 + b1)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * g) @ a
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return h, t, g, bag, alpha, z, 1 / (1 + np.exp(-np.clip(z @ c + b, -30, 30)))

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(bags) - self.mean) / self.scale
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
        return self._forward(np.clip(x, -8, 8), starts)[-1]

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, by each of the weights."""
        hid, t, g, bag, alpha, z, p = self._forward(x, starts)
        w1, b1, v, u, a, c, b = self.weights
        dlogit = (p - labels) / len(labels)
        dz = dlogit[:, None] * c
        dalpha = (hid * dz[bag]).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[bag])
        dt, dg = de[:, None] * a * g * (1 - t * t), de[:, None] * a * t * g * (1 - g)
        dh = (alpha[:, None] * dz[bag] + dt @ v.T + dg @ u.T) * (1 - hid * hid)
        return [x.T @ dh, dh.sum(0), hid.T @ dt, hid.T @ dg, (t * g).T @ de, z.T @ dlogit, dlogit.sum()]

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, s: Settings, seed: int = 3) -> Model:
        """Cross-entropy by Adam; gradients through the attention by hand."""
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags).astype(np.float64)
        mean, scale = every.mean(0), every.std(0) + 1e-3
        d, h, k = every.shape[1], s.hidden, s.gate
        ws = [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, (h, k)), rng.normal(0, h**-0.5, (h, k)), rng.normal(0, k**-0.5, k), rng.normal(0, h**-0.5, h), np.zeros(())]
        rate_1 = labels.mean()
        ws[-1] = np.array(np.log((rate_1 + 1e-3) / (1 - rate_1 + 1e-3)))
        model = cls(s, mean, scale, ws)
        m1, m2, step = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
        data = [np.clip((b - mean) / scale, -8, 8) for b in bags]
        for _ in range(s.epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), s.batch):
                own = order[lo : lo + s.batch]
                x = np.concatenate([data[i] for i in own])
                starts = np.concatenate([[0], np.cumsum([len(data[i]) for i in own])[:-1]])
                grads = model.gradients(x, starts, labels[own])
                step += 1
                for i, gr in enumerate(grads):
                    gr = gr + s.decay * model.weights[i]
                    m1[i] = 0.9 * m1[i] + 0.1 * gr
                    m2[i] = 0.999 * m2[i] + 0.001 * gr * gr
                    model.weights[i] = model.weights[i] - s.rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings | None = None) -> Model | None:
    """Fits on about settings.rows labelled documents, chosen by a hash of key and label; null keys and labels take
    no part, repeated labels count once, and documents of one key each count. None if there is no label."""
    s = settings or Settings()
    usable = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("y")).where("k is not null and y is not null").distinct()
    chosen = bounded_sample(usable, s.rows, "k", "y")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "k")  # about s.rows
    size = F.greatest(F.ceil(F.coalesce(F.octet_length("t"), F.lit(0)) / s.passage), F.lit(1))
    rows = rows.where(size <= s.longest)
    # many rows of one key, or long ones, are thinned out by a hash of the whole row
    total = rows.agg(F.sum(size).alias("n")).first().n or 0
    if total > s.total:
        rows = rows.where(F.pmod(F.xxhash64("k", "y", "t", F.lit(1)), F.lit(1 << 31)) < F.lit(int(s.total / total * (1 << 31))))

    def work():
        return lambda texts: [[passages(t.as_py(), s.passage).tobytes() for t in texts]]

    found = add_by_batch(rows, ["t"], [T.StructField("x", T.BinaryType(), False)], work).select("k", "y", "x").collect()
    found.sort(key=lambda r: (r.k, r.y, r.x))
    if not found:
        return None
    return Model.fit([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in found], np.array([r.y for r in found]), s)


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) for every whole text.

    Null and empty texts count as one blank passage and get its score; without a model every score is 0.5. Rows stay as
    they are; columns of the names added are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m = shared.value

        def run(column):
            scores: list[float] = []
            for lo in range(0, len(column), 256):
                texts = column.slice(lo, 256).to_pylist()
                scores += m.score([passages(t, m.s.passage) for t in texts]).tolist() if m else [0.5] * len(texts)
            return scores, [int(x >= 0.5) for x in scores]

        return run

    return add_by_batch(docs, [text], [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)], work)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    return scored(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
