"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, aside, bounded_sample, table


@dataclass(frozen=True)
class Settings:
    """rows: labelled texts that the model is fitted on, about; landmarks: texts of the Nyström map; orders: lengths of the
    n-grams (bytes of the folded text); bits: size of the n-gram table; ridge: penalty; least: score below which a
    document's language counts as unsure."""

    rows: int = 4_000
    landmarks: int = 240
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    ridge: float = 1e-3
    least: float = 0.35


_ASCII_LETTER = re.compile(r"[A-Za-z]")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether a character is of one of Unicode's categories of letters; fractions, exponents and numerals are not."""
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(text: str, s: Settings) -> np.ndarray:
    """Numbers of the n-grams that occur in the whole text: letters in lower case, all else one blank."""
    return np.flatnonzero(_seen(text, s))


def _seen(text: str, s: Settings) -> np.ndarray:
    b = (" " + _NO_LETTERS.sub(" ", text.lower()).strip() + " ").encode()
    x = np.frombuffer(b, np.uint8).astype(np.uint32)
    seen = np.zeros(1 << s.bits, bool)
    for order in s.orders:
        if len(x) < order:
            continue
        h = np.full(len(x) - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(order):
            h = (h ^ x[i : len(x) - order + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        seen[(h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - s.bits)] = True
    return seen


class Model:
    """k(x, y) = shared n-grams / root of the product of both numbers; features are kernels with the landmarks, whitened."""

    def __init__(self, found: list[np.ndarray], langs: list[str], s: Settings):
        """found: the n-grams of each text."""
        self.s, self.langs = s, sorted(set(langs))
        # landmarks: as many of each language as there are, in turn
        by_lang = {a: [i for i, b in enumerate(langs) if a == b] for a in self.langs}
        turn = [own[k] for k in range(max(map(len, by_lang.values()))) for own in by_lang.values() if k < len(own)]
        marks = turn[: s.landmarks]
        self.marks = np.zeros((1 << s.bits, len(marks)), np.float32)
        for j, i in enumerate(marks):
            self.marks[found[i], j] = 1 / np.sqrt(max(1, len(found[i])))
        own = self._kernel([found[i] for i in marks])
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        good = values > 1e-6 * values.max()
        self.white = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        z = self._features(found).astype(np.float64)
        y = np.array([[1.0 if a == b else -1.0 for b in self.langs] for a in langs])
        # every language weighs as much as any other
        weight = np.array([1 / len(by_lang[a]) for a in langs]) * len(langs) / len(self.langs)
        z1 = np.hstack([z, np.ones((len(z), 1))])
        penalty = s.ridge * len(z) * np.eye(z1.shape[1])
        penalty[-1, -1] = 0
        self.beta = np.linalg.solve((z1 * weight[:, None]).T @ z1 + penalty, (z1 * weight[:, None]).T @ y)

    def _kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Kernels of texts (rows) with the landmarks: a row of presences times the matrix of landmarks."""
        out = np.zeros((len(found), self.marks.shape[1]), np.float32)
        for lo in range(0, len(found), 128):
            part = found[lo : lo + 128]
            present = np.zeros((len(part), self.marks.shape[0]), np.float32)
            for i, f in enumerate(part):
                present[i, f] = 1 / np.sqrt(max(1, len(f)))
            out[lo : lo + 128] = present @ self.marks
        return out

    def _features(self, found: list[np.ndarray]) -> np.ndarray:
        return self._kernel(found) @ self.white

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and a score from 0 to 1; und and 0 for texts without a letter."""
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if at:
            z = self._features([grams(texts[i], self.s) for i in at]).astype(np.float64)
            f = z @ self.beta[:-1] + self.beta[-1]
            best = f.argmax(1)
            for i, b, row in zip(at, best.tolist(), f, strict=True):
                langs[i], scores[i] = self.langs[b], float(np.clip((row[b] + 1) / 2, 0, 1))
        return langs, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings | None = None) -> Model | None:
    """Fits on about settings.rows rows, chosen by a hash of all columns; null labels and texts, and texts
    without a letter, take no part. None if no row does."""
    s = settings or Settings()
    told_apart = F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns if c != text and not isinstance(labelled.schema[c].dataType, T.MapType)], F.col(f"`{text}`"))
    usable = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"), told_apart.alias("h")).where("t is not null and l is not null")
    rows = bounded_sample(usable, s.rows, "h").select("t", "l")

    def work():
        return lambda texts: [[np.packbits(_seen(t, s)).tobytes() if has_letter(t) else None for t in texts.to_pylist()]]

    # 2^bits bits a text, however long it is
    found = add_by_batch(rows, ["t"], [T.StructField("g", T.BinaryType(), True)], work).where("g is not null").select("g", "l").collect()
    found.sort(key=lambda r: (r.l, r.g))
    return Model([np.flatnonzero(np.unpackbits(np.frombuffer(r.g, np.uint8))) for r in found], [r.l for r in found], s) if found else None


def languages(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score for every whole text.

    `und` and 0 go to null and empty texts, texts without a letter, and all if there is no model. Of equally likely languages
    the first by name wins; repeated rows get equal results, and each counts in training. Rows stay as they are;
    columns of the names added are replaced. The model's size depends on its settings alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m = shared.value

        def run(column):
            texts = column.to_pylist()
            return m.predict(texts) if m else (["und"] * len(texts), [0.0] * len(texts))

        return run

    return add_by_batch(docs, [text], [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)], work)


def known_languages(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents whose language is known: those with a letter and a score of at least settings.least."""
    s = settings or Settings()
    own, back = aside(docs, ["lang_pred", "score"])
    found = languages(own, fit(docs, settings=s))
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= s.least)))


def held_out(key: str, parts: int, part: int):
    """Whether crc32 of a key as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % parts == part, F.lit(False))


def op8_query(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return languages(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
