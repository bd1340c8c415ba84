"""Token-id output: shards of raw ids, each with a minimal perfect hash index from document keys to offsets.

Format: a Parquet table of shards (Spark's writer commits whole tasks only, so a lost executor leaves no torn shard). A row is

    pid, seq           write task and place in it; ascending (pid, seq) is ascending key order
    min_key, max_key   range of the keys, for finding a shard by Parquet's statistics; n_nulls: documents without a key
    n_docs, n_tokens   counts; before: tokens of the same task's earlier shards
    width              bytes of an id (2 or 4)
    payload            the ids of all documents, little-endian, end to end
    offsets            n_docs + 1 unsigned 64-bit places in the payload, in ids
    keys               n_docs signed 64-bit keys and, in nulls, a byte each that is 1 for a null key
    seeds, prints, firsts   the index: a seed for each bucket, and for each slot a 32-bit fingerprint and the number of
                       the first document with that key (repeated keys stand next to each other)
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, scratch, table

#: Ids of a shard, unless one document has more.
SHARD_TOKENS = 1 << 20
#: Ratio of keys to buckets of the index.
BUCKET_KEYS = 4
#: Pieces of words that a worker remembers the ids of.
REMEMBERED = 400_000
#: Ranges of keys that are sorted by a task each: of about RANGE_ROWS documents, but one for each core, and MOST_RANGES at
#: most; and keys that are sampled for each. Of wider ranges, fewer words are new to the task that encodes them.
RANGE_ROWS, MOST_RANGES, RANGE_KEYS = 10_000, 50_000, 20
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 8 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each key; the null key has its own."""
    h = _mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.where(nulls, np.uint64(0x6A09E667F3BCC909), h)


class PerfectHash:
    """Hash, displace and compress: buckets get a seed that sends their keys to free slots; n keys fill n slots."""

    def __init__(self, seeds: np.ndarray, prints: np.ndarray, firsts: np.ndarray):
        self.seeds, self.prints, self.firsts = seeds, prints, firsts

    @classmethod
    def build(cls, hashes: np.ndarray, firsts: np.ndarray) -> PerfectHash:
        """hashes: distinct, at least one; firsts: the value of each."""
        n = len(hashes)
        n_buckets = max(1, -(-n // BUCKET_KEYS))
        bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        starts = np.cumsum(sizes) - sizes
        seeds, slots, taken = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        # buckets of one size at a time, the largest first
        for size in np.unique(sizes[sizes > 0])[::-1].tolist():
            open_ = np.flatnonzero(sizes == size)
            members = order[starts[open_][:, None] + np.arange(size)]
            at = np.zeros(len(open_), np.int64)
            while len(open_):
                # some seeds of every open bucket at once: the fewer are open, the more seeds
                tried = at[:, None] + np.arange(max(1, 4096 // (len(open_) * size)))
                got = cls._slots(hashes[members][:, None, :], tried[:, :, None], n)
                fits = ~taken[got].any(axis=2)
                if size > 1:
                    ordered = np.sort(got, axis=2)
                    fits &= (ordered[:, :, 1:] != ordered[:, :, :-1]).all(axis=2)
                first, row = fits.argmax(axis=1), np.arange(len(open_))
                found = fits[row, first]
                chosen = got[row, first]
                at = np.where(found, tried[row, first], tried[:, -1] + 1)
                # of buckets that want one slot, the first gets it; the others look again
                owner = np.full(n, len(open_))
                np.minimum.at(owner, chosen[found].ravel(), np.repeat(row[found], size))
                won = found & (owner[chosen] == row[:, None]).all(axis=1)
                seeds[open_[won]] = at[won]
                slots[members[won]] = chosen[won]
                taken[chosen[won]] = True
                open_, members, at = open_[~won], members[~won], at[~won]
        prints, values = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        prints[slots], values[slots] = (hashes >> np.uint64(32)).astype(np.uint32), firsts
        return cls(seeds, prints, values)

    @staticmethod
    def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        x = h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each key by its hash, or -1 if the fingerprint differs; constant time a key."""
        if not len(self.prints):
            return np.full(len(hashes), -1)
        slot = self._slots(hashes, self.seeds[(hashes % np.uint64(len(self.seeds))).astype(np.int64)], len(self.prints))
        return np.where(self.prints[slot] == hashes >> np.uint64(32), self.firsts[slot].astype(np.int64), -1)


class Shard:
    """One row of the store, with or without its payload."""

    def __init__(self, row: dict):
        self.offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
        self.keys, self.nulls = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.hashes = key_hash(self.keys, self.nulls)
        self.index = PerfectHash(*(np.frombuffer(row[c], "<u4") for c in ("seeds", "prints", "firsts")))

    def firsts(self, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """Number of the first document with each key, or -1: through the index, its fingerprint, then the stored key itself."""
        first = self.index.find(key_hash(keys, nulls))
        same = (self.nulls[first] == nulls) & (nulls | (self.keys[first] == keys))
        return np.where((first >= 0) & same, first, -1)

    def documents(self, key: int | None) -> range:
        """Numbers of the documents with this key, which stand next to each other."""
        first = int(self.firsts(np.array([key or 0], np.int64), np.array([key is None]))[0])
        if first < 0:
            return range(0)
        last = first + 1
        while last < len(self.keys) and self.hashes[last] == self.hashes[first]:
            last += 1
        return range(first, last)

    def all(self) -> np.ndarray:
        """The number of every document as the index gives it: the first with its key, and its place among those."""
        starts = _runs(self.hashes)
        found = self.firsts(self.keys[starts], self.nulls[starts])
        if (found < 0).any():
            raise ValueError("a shard's index does not know a key that the shard holds")
        run = np.cumsum(np.isin(np.arange(len(self.keys)), starts)) - 1
        return found[run] + np.arange(len(self.keys)) - starts[run]


def _runs(hashes: np.ndarray) -> np.ndarray:
    """Where runs of equal hashes start."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]]))


SHARDS = T.StructType(
    [T.StructField(n, T.IntegerType(), False) for n in ("pid", "seq")]
    + [T.StructField(n, T.LongType(), True) for n in ("min_key", "max_key")]
    + [T.StructField(n, T.LongType(), False) for n in ("n_nulls", "n_docs", "n_tokens", "before")]
    + [T.StructField("width", T.IntegerType(), False)]
    + [T.StructField(n, T.BinaryType(), False) for n in ("payload", "offsets", "keys", "nulls", "seeds", "prints", "firsts")]
)


def _shard(keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, payload: bytes, width: int) -> dict:
    """A row of the store; keys are in order, those of nulls 0, and lengths count ids."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    hashes = key_hash(keys, nulls)
    first = _runs(hashes)
    index = PerfectHash.build(hashes[first], first)
    known = keys[~nulls]
    return {
        "min_key": int(known[0]) if len(known) else None, "max_key": int(known[-1]) if len(known) else None, "n_nulls": int(nulls.sum()), "n_docs": len(keys), "n_tokens": int(offsets[-1]), "width": width,
        "payload": payload, "offsets": offsets.tobytes(), "keys": keys.astype("<i8").tobytes(), "nulls": nulls.astype(np.uint8).tobytes(),
        "seeds": index.seeds.astype("<u4").tobytes(), "prints": index.prints.astype("<u4").tobytes(), "firsts": index.firsts.astype("<u4").tobytes(),
    }


class WordEncoder:
    """ids of whole texts by a file of the tokenizers library.

    With the layout of normalizer and splitter that such word vocabularies have, no token and no rule reaches across blank
    ASCII white space. So Arrow cuts a batch into words and numbers the different ones. These go through the library's
    normalizer and the splitting pattern of the file, and their pieces, which are remembered, through the library's model.
    Any other layout gets the library's encoding of whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.width = self._prepare(json.load(f), pre_tokenizers)
        self.dtype = np.dtype(f"<u{self.width}")

    def _prepare(self, spec: dict, pre_tokenizers) -> int:
        import regex

        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
            and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
            and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"] and spec["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or not t["special"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        if self.by_word:
            # the library's white space is Unicode's; Python's has \\x1c-\\x1f besides
            plain = splits[0]["pattern"]["Regex"].replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
            self.ascii_pieces = (regex if r"\p" in plain else re).compile(f"(?:{plain})| ").findall
            self.pieces = regex.compile("(?:" + splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + ")| ").findall
            letters = pre_tokenizers.ByteLevel.alphabet()
            plain = [c for c in range(256) if chr(c) in letters]  # bytes that stand for themselves; the others follow 255
            self.level = {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in set(plain))}
            # what only single words may hold: added tokens, and blanks other than those between words
            self.odd = re.compile("|".join([r"[^\S ]", *(re.escape(t["content"]) for t in spec["added_tokens"])]))
            self.tokenize = self.tokenizer.model.tokenize
            self.parts = Remembered(self._piece)
        return 2 if size < 1 << 16 else 4

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._packed([t.id for t in self.tokenize(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.level))])

    def _groups(self, words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of some words, their ids end to end, their number in each) until all words of an Arrow array are done.
        All ASCII words are one text to normalizer and pattern, a blank between them; so are all others."""
        import pyarrow.compute as pc

        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        for ascii_ in (True, False):
            rows = np.flatnonzero(plain == ascii_)
            text = " ".join(own := words.take(rows).to_numpy(zero_copy_only=False).tolist())
            if self.odd.search(text):
                found = np.fromiter((self.odd.search(w) is not None for w in own), bool, len(own))
                alone = [self.tokenizer.encode(own[i], add_special_tokens=False).ids for i in np.flatnonzero(found)]
                yield rows[found], np.array([i for ids in alone for i in ids], self.dtype), np.array([len(ids) for ids in alone])
                rows = rows[~found]
                text = " ".join(w for w, f in zip(own, found, strict=True) if not f)
            if len(rows):
                self.parts[" "] = b"|"  # one byte: its length marks it among ids of two or four
                parts = list(map(self.parts.__getitem__, self.ascii_pieces(text.lower()) if ascii_ else self.pieces(self.tokenizer.normalizer.normalize_str(text))))
                self.parts.trim()
                n = np.fromiter(map(len, parts), np.int64, len(parts))
                ends, cuts = np.cumsum(n), np.flatnonzero(n == 1)
                ids = np.delete(np.frombuffer(b"".join(parts), np.uint8), ends[cuts] - 1).view(self.dtype)
                places = np.concatenate([[0], ends[cuts] - np.arange(1, len(cuts) + 1), [ends[-1] - len(cuts) if len(ends) else 0]])
                yield rows, ids, np.diff(places) // self.width

    def encode(self, text: str) -> np.ndarray:
        import pyarrow as pa

        return self.encode_batch(pa.array([text], pa.string()))[0]

    def encode_batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, their number in each) of an Arrow array of strings; nulls have none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], self.dtype), np.fromiter(map(len, got), np.int64, len(got))
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        start, size = np.zeros((2, len(coded.dictionary)), np.int64)
        pools, base = [np.zeros(0, self.dtype)], 0
        for rows, ids, n in self._groups(coded.dictionary):
            start[rows], size[rows] = base + np.cumsum(n) - n, n
            pools.append(ids)
            base += len(ids)
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.concatenate(pools)[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], n)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])


class Remembered(dict):
    """Results by argument. As it fills up, what was not asked for since the last time goes."""

    def __init__(self, f: Callable[[str], bytes], most: int = REMEMBERED):
        self.f, self.most, self.old = f, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.f(key)
        if len(key) <= 64:
            self[key] = got
        return got

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _slices(column, most: int = ENCODED_BYTES) -> Iterator:
    """The column in slices of about `most` bytes of text, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield column.slice(lo, hi - lo)
        lo = hi


class Ranges:
    """Bounds of about equal ranges of keys, nulls first; rows of one key are told apart by a hash."""

    def __init__(self, keys: np.ndarray, nulls: np.ndarray, hashes: np.ndarray, parts: int):
        """Of a sample of keys, with a hash each."""
        order = np.lexsort((hashes, keys, ~nulls))
        cut = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
        self.n_nulls = int(nulls[cut].sum())
        self.keys, self.hashes = keys[cut], hashes[cut]

    def place(self, keys: np.ndarray, nulls: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range that each row belongs to, in ascending order of (key, hash)."""
        own, n = self.keys[self.n_nulls :], self.n_nulls
        low, high = np.searchsorted(own, keys, "left") + n, np.searchsorted(own, keys, "right") + n
        low[nulls], high[nulls] = 0, n
        for a in np.unique(low[low < high]).tolist():  # keys that are bounds themselves
            rows = np.flatnonzero((low == a) & (low < high))
            low[rows] = a + np.searchsorted(self.hashes[a : high[rows[0]]], hashes[rows], "right")
        return low


def _ranges(docs: DataFrame, key: str) -> tuple[Ranges, int]:
    """Bounds from a random sample of keys (RANGE_KEYS a range). They set the sizes of tasks, no row of the result: hashes of
    texts are spread evenly, so random numbers stand in for them and no text is read."""
    spark = docs.sparkSession
    keys = docs.select(F.col(f"`{key}`").cast("long").alias("k"))
    total = keys.count()
    parts = max(spark.sparkContext.defaultParallelism, min(MOST_RANGES, total // RANGE_ROWS))
    got = keys.sample(min(1.0, RANGE_KEYS * parts / max(1, total)), seed=1).toArrow().column("k").combine_chunks()
    nulls = got.is_null().to_numpy(zero_copy_only=False)
    return Ranges(got.fill_null(0).to_numpy(), nulls, np.random.default_rng(1).integers(-(2**63), 2**63 - 1, len(got)), parts), parts


def _placed(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """rows with p, the range of (k, h)."""
    shared = rows.sparkSession.sparkContext.broadcast(ranges)

    @F.pandas_udf("int")
    def place(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.place(k.fillna(0).to_numpy(np.int64), k.isna().to_numpy(), h.to_numpy()))

    return rows.withColumn("p", place("k", "h"))


def write_shards(docs: DataFrame, path: str, encoder: Callable[[], Callable], width: int, end_id: int, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every text, appends end_id, and writes shards in ascending key order (null keys first).

    encoder() gives f(Arrow array of texts) -> (ids end to end, `width` bytes each, their number in each text). Null texts
    count as empty (just the end id); rows with equal keys are kept, in the order of their texts' hashes, so that a key that
    many rows share is dealt to many tasks. Ranges of keys come from a sample of keys alone: texts are read once and
    shuffled once, and encoded where they are written.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    bound_batches(docs.sparkSession)
    ranges, n_ranges = _ranges(docs, key)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("t"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, end = encoder(), np.array(end_id, f"<u{width}")
        pid, seq, before, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []

        def out():
            keys, nulls, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
            row = _shard(keys, nulls, lengths, b"".join(h[3] for h in held), width) | {"pid": pid, "seq": seq, "before": before}
            return pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(SHARDS))

        for b in batches:
            all_keys, all_nulls, done = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False), 0
            for part in _slices(b.column(1)):
                keys, nulls = all_keys[done : done + len(part)], all_nulls[done : done + len(part)]
                done += len(part)
                ids, lengths = encode(part)
                data = np.insert(ids, np.cumsum(lengths), end)  # each document's ids, then end_id
                lengths = lengths + 1
                ends, lo = np.concatenate([[0], np.cumsum(lengths)]), 0
                while lo < len(keys):
                    # up to and with the document that fills the shard
                    hi = min(len(keys), int(np.searchsorted(ends[1:], shard_tokens - size + ends[lo])) + 1)
                    held.append((keys[lo:hi], nulls[lo:hi], lengths[lo:hi], data[ends[lo] : ends[hi]].tobytes()))
                    size += int(ends[hi] - ends[lo])
                    lo = hi
                    if size >= shard_tokens:
                        yield out()
                        seq, before, size = seq + 1, before + size, 0
                        held.clear()
        if held:
            yield out()

    ordered = _placed(rows, ranges).repartitionById(n_ranges, "p").sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("h")).select("k", "t")
    # row groups of a few shards, so that a reader's batch stays small
    ordered.mapInArrow(build, SHARDS).write.option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).parquet(path)


DOCS = T.StructType([T.StructField("key", T.LongType(), True)] + [T.StructField(n, T.LongType(), False) for n in ("start", "n_tokens", "ids_crc32")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored document, read from the files by its key's index entry: key, start (ids of all documents
    before it), n_tokens and ids_crc32 (unsigned, over the ids as little-endian 32-bit integers). An index that does not
    know a key of its shard fails the job. An empty store gives no rows."""
    import pyarrow as pa

    bound_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    # one row for each write task; the shards themselves hold their place within it
    tasks = shards.groupBy("pid").agg(F.sum("n_tokens").alias("total")).orderBy("pid").collect()
    bases, base = {}, 0
    for pid, total in tasks:
        bases[pid] = base
        base += total
    shared = spark.sparkContext.broadcast(bases)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                shard, at = Shard(row), shared.value[row["pid"]] + row["before"]
                docs = shard.all()
                lo, hi = shard.offsets[docs], shard.offsets[docs + 1]
                ids = memoryview(np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, mask=shard.nulls), pa.array(at + lo), pa.array(hi - lo), pa.array(crc, pa.int64())], names=DOCS.names)

    return shards.drop("min_key", "max_key", "n_nulls", "n_docs", "n_tokens").mapInArrow(read, DOCS)


def holding(shards: DataFrame, keys: list[int | None], ranges: int = 64) -> DataFrame:
    """The shards whose key range may hold one of the keys. Close keys are asked for as one range, of which there are
    `ranges` at most, so that Parquet's statistics drop all other shards unread; each key decides then."""
    known = sorted({k for k in keys if k is not None})
    cuts = sorted(sorted(range(1, len(known)), key=lambda i: known[i - 1] - known[i])[: ranges - 1])
    runs = [known[a:b] for a, b in zip([0, *cuts], [*cuts, len(known)], strict=True)] if known else []
    near = reduce(lambda x, y: x | y, [(F.col("min_key") <= r[-1]) & (F.col("max_key") >= r[0]) for r in runs], F.lit(False))
    exact = F.exists(F.lit(known or [0]).cast("array<long>"), lambda k: (F.col("min_key") <= k) & (F.col("max_key") >= k))
    found = near & exact if known else F.lit(False)
    return shards.where(found | (F.col("n_nulls") > 0) if None in keys else found)


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """The ids of a bounded list of keys: key, ids. Indexes of the shards whose key range holds one are asked first;
    payloads are read of shards that do hold one. Unknown keys give no row, repeated keys one for each document."""
    import pyarrow as pa

    bound_batches(spark)
    shards = holding(spark.read.schema(SHARDS).parquet(path), keys)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                shard = Shard(row)
                found = [(row["pid"], row["seq"], k, int(shard.offsets[d]), int(shard.offsets[d + 1])) for k in dict.fromkeys(keys) for d in shard.documents(k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["pid", "seq", "key", "lo", "hi"])

    at = shards.select("pid", "seq", "offsets", "keys", "nulls", "seeds", "prints", "firsts").mapInArrow(places, "pid int, seq int, key long, lo long, hi long")
    # a shard's payload is sent once for all of its documents
    wanted = at.groupBy("pid", "seq").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("docs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                yield pa.RecordBatch.from_arrays([pa.array([d["key"] for d in row["docs"]], pa.int64()), pa.array([ids[d["lo"] : d["hi"]].tolist() for d in row["docs"]], pa.list_(pa.int64()))], names=["key", "ids"])

    schema = T.StructType([T.StructField("key", T.LongType(), True), T.StructField("ids", T.ArrayType(T.LongType(), False), False)])
    return shards.select("pid", "seq", "width", "payload").join(wanted, ["pid", "seq"]).select("width", "payload", "docs").mapInArrow(cut, schema)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public word vocabulary, written as shards and read back."""
    import public_tokenizers as P

    vocabulary = P.path("word_bpe_49k.json")
    path = scratch(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, lambda: word_encoder(vocabulary).encode_batch, word_encoder(vocabulary).width, end_id=1)
    return read_documents(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
