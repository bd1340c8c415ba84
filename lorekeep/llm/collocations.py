"""Phrase collocation mining, partitioned by pivots as in MG-FSM (Miliaraki et al. 2013).

An n-gram belongs to its rarest word, its pivot (the first one, if it occurs twice). Around every occurrence of a word its
surroundings are rewritten: words that are rarer end them, as no n-gram of this pivot holds them. Equal fragments are counted
once, routed to their pivot, and mined there: n-grams that hold the pivot, and no others, so that every occurrence in
the corpus is counted in one place.

Frequencies of words come from all documents. Tasks get them by hashed buckets: a bucket's sum bounds the frequency of each
of its words, so a bucket below the threshold holds no word of any candidate. Its sum also orders the words; the exact counts
of what is mined decide in the end.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored, table
from .token_store import _slices


@dataclass(frozen=True)
class Settings:
    """most: words of a phrase; least: occurrences of a candidate; cover: percentage of a candidate's occurrences from which a longer
    candidate makes it superfluous; top: phrases reported of each language; buckets: sums of word frequencies that tasks
    get; route: occurrences of a pivot from which its fragments are dealt out to several places."""

    most: int = 5
    least: int = 100
    cover: int = 100
    top: int = 2_000
    buckets: int = 1 << 20
    route: int = 200_000


_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it hands them on.
_HELD = 500_000


def words(text: bytes) -> list[bytes]:
    """Words of a text in order, A-Z in lower case, and b"\\n" wherever a piece ends."""
    found = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    return [w for w in found if w] if b"" in found else found


def _by_lang(batch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch (lang, text) by language, joined by piece ends, in parts of bounded size."""
    import pyarrow.compute as pc

    langs = batch.column(0).fill_null("und")
    for lang in pc.unique(langs).to_pylist():
        for part in _slices(batch.column(1).filter(pc.equal(langs, lang))):
            yield lang, b"\n".join(t.as_buffer().to_pybytes() for t in part if t.is_valid)


def _quoted(lang: str) -> str:
    """Without tabs."""
    return lang.replace("%", "%25").replace("\t", "%09")


def _unquoted(lang: str) -> str:
    return lang.replace("%09", "\t").replace("%25", "%")


def _strings(items: list[bytes]):
    import pyarrow as pa

    return pa.array(items, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang (null: und), word, n of all words of whole texts."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for own, c in counts.items():
            c.pop(b"\n", None)
            items = list(c.items())
            for lo in range(0, len(items), 20_000):
                part = items[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(part), pa.string()), _strings([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for own, t in _by_lang(b):
                counts.setdefault(own, Counter()).update(words(t))
                if sum(map(len, counts.values())) > _HELD:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    found = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(count, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bucket_sums(counts: DataFrame, buckets: int) -> np.ndarray:
    """Sums of frequencies by hash of language and word: as many numbers as there are buckets, whatever the corpus."""
    place = (F.crc32(F.concat("lang", F.lit(" "), "word").cast("binary")) % buckets).cast("int")
    found = counts.groupBy(place.alias("b")).agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(buckets, np.int64)
    sums[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return sums


def grouped(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of different rows of a matrix of integers, and the sums of their weights."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if (same & (rows[order[1:]] != rows[order[:-1]]).any(axis=1)).any():  # different rows of one hash
        order = np.lexsort(rows.T)
        same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    return order[starts], np.add.reduceat(weights[order], starts)


class _Numbered(dict):
    """Words by number, in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def surroundings(key: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each place's fragment goes to the left (words with greater keys alone) and to the right (equal ones too), up
    to `reach`. Keys are 0 where nothing may pass."""
    n = len(key)
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on_left, on_right = key > 0, key > 0
    for d in range(1, reach + 1):
        on_left = on_left & (np.concatenate([np.zeros(min(d, n), key.dtype), key[:-d]]) > key)
        on_right = on_right & (np.concatenate([key[d:], np.full(min(d, n), -1, key.dtype)]) >= key)
        left += on_left
        right += on_right
    return left, right


def _joined(ids: np.ndarray, ends: np.ndarray, vocabulary):
    """Strings of words, joined by blanks: ids of words in a row, and where each string ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), vocabulary.take(pa.array(ids))), " ")


def fragments(docs: DataFrame, sums: np.ndarray, settings: Settings, text: str = "text", lang: str = "lang") -> DataFrame:
    """route, head, fragment. A route is a bucket of pivots, or a part of it (an odd number) if the bucket holds many occurrences.
    head: 16 times the number of equal fragments, and the pivot's place in it, from 0. A fragment is its language, a tab, and
    its words. Rows come in order of routes, so that equal words stand together in what is shuffled."""
    import pyarrow as pa
    import pyarrow.compute as pc

    s, reach = settings, settings.most - 1
    bound_batches(docs.sparkSession)
    # 0 for buckets that are too rare; then by sum
    order = np.argsort(sums, kind="stable")
    ranks = np.zeros(len(sums), np.int32)
    ranks[order] = np.arange(1, len(sums) + 1)
    ranks[sums < s.least] = 0
    shared = docs.sparkSession.sparkContext.broadcast((ranks, np.ceil(sums / s.route).astype(np.int32)))

    def cut(own: str, t: bytes, turn: int) -> Iterator[pa.RecordBatch]:
        ranks, shares = shared.value
        number = _Numbered({b"\n": 0})
        found = words(t)
        ids = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
        del found
        start = zlib.crc32(own.encode() + b" ")
        buckets = np.fromiter((zlib.crc32(w, start) for w in number), np.uint32, len(number)).astype(np.int64) % len(ranks)
        keys = ranks[buckets]
        keys[0] = 0
        key = keys[ids]
        left, right = surroundings(key, reach)
        at = np.flatnonzero((left > 0) | (right > 0))
        left, right = left[at], right[at]
        around = np.arange(-reach, reach + 1)
        inside = (around >= -left[:, None]) & (around <= right[:, None])
        rows = np.where(inside, ids[np.clip(at[:, None] + around, 0, max(0, len(ids) - 1))], -1)
        chosen, n = grouped(rows, np.ones(len(rows), np.int64))
        rows, left = rows[chosen], left[chosen]
        pivots = buckets[rows[:, reach]]
        parts = shares[pivots]
        salt = (np.arange(len(rows)) + turn) % np.maximum(parts, 1)
        routes = (pivots << 24 | salt << 1 | (parts > 1)).astype(np.int64)
        sorted_ = np.lexsort((rows[:, reach + 1], rows[:, reach], routes))
        rows, routes, heads = rows[sorted_], routes[sorted_], (n * 16 + left)[sorted_]
        vocabulary, prefix = _strings(list(number)), pa.scalar(_quoted(own) + "\t")
        for lo in range(0, len(rows), 50_000):
            part = rows[lo : lo + 50_000]
            kept, hi = part >= 0, lo + len(part)
            joined = _joined(part[kept], np.cumsum(kept.sum(axis=1)), vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(routes[lo:hi]), pa.array(heads[lo:hi]), pc.binary_join_element_wise(prefix, joined, "")], names=["route", "head", "fragment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        for b in batches:
            for own, t in _by_lang(b):
                turn += 1
                yield from cut(own, t, turn)

    return docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "route long, head long, fragment string")


def mined(routed: DataFrame, settings: Settings) -> DataFrame:
    """lang, phrase, n: the n-grams of 2 words or more that hold their fragment's pivot. Those of whole routes are complete, and
    come if they are frequent enough; others are parts of sums. Memory is that of a few ten thousand fragments."""
    import pyarrow as pa
    import pyarrow.compute as pc

    s = settings
    out = ["lang", "phrase", "n"]

    def mine(part: pa.Table) -> Iterator[pa.RecordBatch]:
        halves = pc.split_pattern(part.column("fragment").combine_chunks(), "\t").values
        at = pa.array(np.arange(0, len(halves), 2))
        lists = pc.split_pattern(halves.take(pc.add(at, 1)), " ")
        ends = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        ids = coded.indices.to_numpy()
        langs = halves.take(at).dictionary_encode()
        names = pa.array([_unquoted(x) for x in langs.dictionary.to_pylist()], pa.string())
        head = part.column("head").to_numpy()
        own, n, whole = langs.indices.to_numpy(), head // 16, part.column("route").to_numpy() % 2 == 0
        pivot = ends[:-1] + head % 16
        windows, froms = [], []
        for size in range(2, s.most + 1):
            for before in range(size):
                rows = np.flatnonzero((pivot - before >= ends[:-1]) & (pivot - before + size <= ends[1:]))
                w = np.full((len(rows), s.most + 1), -1, np.int32)
                w[:, 0] = own[rows]
                w[:, 1 : size + 1] = ids[(pivot[rows] - before)[:, None] + np.arange(size)]
                windows.append(w)
                froms.append(rows)
        w, rows = np.concatenate(windows), np.concatenate(froms)
        at, sums = grouped(w, n[rows])
        good = (sums >= s.least) | ~whole[rows[at]]
        at, sums = at[good], sums[good]
        for lo in range(0, len(at), 50_000):
            own_words = w[at[lo : lo + 50_000], 1:]
            kept = own_words >= 0
            yield pa.RecordBatch.from_arrays([names.take(pa.array(w[at[lo : lo + 50_000], 0])), _joined(own_words[kept], np.cumsum(kept.sum(axis=1)), coded.dictionary), pa.array(sums[lo : lo + 50_000])], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            held.append(t)
            if sum(map(len, held)) < 40_000:
                continue
            all_held = pa.concat_tables(held)
            routes = all_held.column("route").to_numpy()
            # a whole route that may go on stays; a part of one need not
            end = int(np.searchsorted(routes, routes[-1])) if routes[-1] % 2 == 0 else len(routes)
            if end:
                yield from mine(all_held.slice(0, end))
            held = [all_held.slice(end)] if end < len(routes) else []
        if held:
            yield from mine(pa.concat_tables(held))

    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(run, "lang string, phrase string, n long")


def phrases(docs: DataFrame, counts: DataFrame, settings: Settings | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, a: all phrases of 2 to settings.most words with settings.least occurrences. counts: word_counts()."""
    s = settings or Settings()
    parts = mined(fragments(docs, bucket_sums(counts, s.buckets), s, text, lang), s)
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= s.least)


def _joined_words(c) -> F.Column:
    return F.array_join(c, " ")


def collocations(docs: DataFrame, settings: Settings | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    n: words of the language; a: occurrences of the phrase within pieces, overlaps included; l, r: those of both parts of the cut
    with the lowest score, floor(1000 a n / (l r)), of equal ones the first. Phrases inside a longer candidate that occurs
    as often (settings.cover) are left out. Order: score, a, both descending, then phrase by its bytes.

    Null and empty texts have no words; a null language is `und`. Repeated rows count again. Without candidates there are
    no rows. Products are decimals of 38 digits.
    """
    s = settings or Settings()
    counts = stored(word_counts(docs, text, lang), "words")
    found = stored(phrases(docs, counts, s, text, lang), "phrases")
    frequent = found.unionByName(counts.where(F.col("n") >= s.least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    w = F.split("phrase", " ")
    split = found.withColumn("w", w)
    # a longer candidate goes on to one of the next shorter ones, which occur no less often: one word more is enough to look at
    inner = split.where(F.size("w") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(_joined_words(F.slice("w", F.lit(1), F.size("w") - 1)), _joined_words(F.slice("w", F.lit(2), F.size("w") - 1)))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = split.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < s.cover * F.col("a"))).drop("longer")
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), _joined_words(F.slice("w", F.lit(1), k)).alias("first"), _joined_words(F.slice("w", k + 1, F.size("w"))).alias("rest")))
    cuts = kept.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    score = F.expr("cast(1000 * cast(a as decimal(18, 0)) as decimal(22, 0)) * cast(n as decimal(15, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= s.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_query(spark, sf_dir: str) -> DataFrame:
    """The collocations of every language of documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
