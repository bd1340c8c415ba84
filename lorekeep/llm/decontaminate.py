"""Benchmark decontamination: Wu-Manber search for all word windows of a test set in whole documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, aside, stored, table

#: Words of a window; shorter items are one window.
WINDOW_WORDS = 10
#: Text of the test set that one matcher holds; a larger set is searched in several passes, each over its own block.
BLOCK_BYTES = 8 << 20

_A, _Z = ord("A"), ord("Z")
#: ASCII letters become lower case, digits stay, the rest of ASCII separates words; all other characters are of words.
_FOLD = bytes(c + 32 if _A <= c <= _Z else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Multi-pattern search by block shifts.

    The last `block` bytes of a window position select a shift: how far the position can move on before the block could
    line up with an equal block in the first `length` bytes of any pattern. Where the shift is 0, the block selects a
    bucket of patterns, and these are compared with the text byte by byte. Positions move on in many lanes at once, one
    for each stretch of the text, so that a step is a few NumPy operations over all lanes. Patterns are places in one
    buffer: about 40 bytes each, beside tables of 8 MB at most.
    """

    def __init__(self, source: bytes, starts: np.ndarray, lengths: np.ndarray, lane: int = 512):
        """Patterns: lengths bytes of source from starts on."""
        self.source, self.lane = source, lane
        self.starts, self.lengths = starts, lengths
        if not len(starts):
            return
        self.length = int(lengths.min())
        self.block = min(8, self.length)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        n_blocks = len(starts) * (self.length - self.block + 1)
        self.bits = np.uint64(64 - min(22, max(16, int(n_blocks * 4).bit_length())))
        self.shift = np.full(1 << int(64 - self.bits), min(self.length - self.block + 1, 65535), np.uint16)
        at = np.ndarray(len(source) + 1, "<u8", source + b"\0" * 8, strides=(1,))  # at[i]: the 8 bytes from i on
        for end in range(self.block, self.length + 1):
            keys = at[starts + (end - self.block)] & self.mask
            np.minimum.at(self.shift, self._hash(keys), min(self.length - end, 65535))
        self.order = np.argsort(keys, kind="stable")  # of the last round: the blocks that end a head
        self.suffixes, first = np.unique(keys[self.order], return_index=True)
        self.bounds = np.append(first, len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence, in no particular order."""
        if not len(self.starts) or len(text) < self.length:
            return
        padded = text + b"\0" * 8
        at = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))
        last = len(text) - self.length  # starts of the heads run from 0 to last
        pos = np.arange(0, last + 1, self.lane, dtype=np.int64)
        end = np.minimum(pos + self.lane, last + 1)
        back = self.length - self.block
        while len(pos):
            keys = at[pos + back] & self.mask
            step = self.shift[self._hash(keys)].astype(np.int64)
            if (zero := np.flatnonzero(step == 0)).size:
                found = np.searchsorted(self.suffixes, keys[zero])
                found[found == len(self.suffixes)] = 0
                for i in np.flatnonzero(self.suffixes[found] == keys[zero]).tolist():
                    start = int(pos[zero[i]])
                    for p in self.order[self.bounds[found[i]] : self.bounds[found[i] + 1]].tolist():
                        a = int(self.starts[p])
                        if text.startswith(self.source[a : a + int(self.lengths[p])], start):
                            yield start, p
            pos = pos + np.maximum(step, 1)
            if not (inside := pos < end).all():
                pos, end = pos[inside], end[inside]


class Matcher:
    """Finds the windows of items in documents: all runs of width words, blank at both ends, or all words of an item that has
    fewer. Very short windows are searched apart, so that they slow no others."""

    def __init__(self, items: Iterable[tuple[int, bytes]], width: int = WINDOW_WORDS, short: int = 24):
        folded, owners, starts, lengths, base = [], [], [], [], 0
        for item, text in items:
            if not (ws := words(text)):
                continue
            folded.append(b" " + b" ".join(ws) + b" ")
            blanks = np.flatnonzero(np.frombuffer(folded[-1], np.uint8) == 32)
            span = min(width, len(ws))
            starts.append(base + blanks[: len(ws) - span + 1])
            lengths.append((blanks[span:] - blanks[: len(ws) - span + 1] + 1).astype(np.int32))
            owners.append(np.full(len(starts[-1]), item, np.int64))
            base += len(folded[-1])
        source, none = b"".join(folded), np.zeros(0, np.int64)
        every, length, owner = (np.concatenate([none, *x]) for x in (starts, lengths, owners))
        parts = [np.flatnonzero((length < short) == few) for few in (True, False)]
        self.searches = [WuManber(source, every[p], length[p]) for p in parts]
        self.owners = [owner[p] for p in parts]

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[dict]], list[list[int]]]:
        """Words of each text, merged runs of hit words as (first, last + 1), and the items that occur."""
        split = [words(t) for t in texts]
        folded = [b" " + b" ".join(ws) + b" " for ws in split]
        begin = np.concatenate([[0], np.cumsum([len(f) + 1 for f in folded])])
        whole = b"\n".join(folded)  # no pattern holds a line feed
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for search, owners in zip(self.searches, self.owners, strict=True):
            for start, p in search.find(whole):
                k = int(np.searchsorted(begin, start, "right")) - 1
                hits.setdefault(k, []).append((start - int(begin[k]), int(search.lengths[p]), int(owners[p])))
        spans: list[list[dict]] = [[] for _ in texts]
        items: list[list[int]] = [[] for _ in texts]
        for k, found in hits.items():
            blanks = np.flatnonzero(np.frombuffer(folded[k], np.uint8) == 32)
            firsts = np.searchsorted(blanks, [s for s, _, _ in found])
            lasts = np.searchsorted(blanks, [s + n - 1 for s, n, _ in found])
            runs: list[list[int]] = []
            for a, b in sorted(zip(firsts.tolist(), lasts.tolist(), strict=True)):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            spans[k] = [{"first": a, "end": b} for a, b in runs]
            items[k] = sorted({i for _, _, i in found})
        return [len(ws) for ws in split], spans, items


#: The matcher that a worker built last, by the name of its block: it serves all tasks of the worker.
_BUILT: dict[str, Matcher] = {}


def _matcher(name: str, block, width: int) -> Matcher:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(block.value, width)
    return _BUILT[name]


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)
ITEMS = T.ArrayType(T.LongType(), False)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of a bounded size; the driver holds one at a time."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, bytes(text)))
        size += len(text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hit_spans (runs of hit words), item_ids (ascending) and n_hit to every row of docs.

    A word is hit if it lies in any occurrence of a window: `width` consecutive words of an item, or all its words if it
    has fewer. Words are runs of ASCII letters (case folded), digits and characters beyond ASCII. A null text has no
    words and no hits; items with a null id or text take no part, and neither do those without words. Repeated items and
    documents count each on their own. Columns of docs with the names added are replaced. The test set is broadcast in
    blocks of at most `block_bytes` (and one item); each block is one narrow pass over the documents.
    """
    sc = docs.sparkSession.sparkContext
    usable = benchmark.where(F.col(f"`{item}`").isNotNull() & F.col(f"`{item_text}`").isNotNull())
    usable = usable.select(F.col(f"`{item}`").cast("long"), F.col(f"`{item_text}`").cast("binary"))
    out, first = docs, True
    fields = [T.StructField("n_words", T.LongType(), False), T.StructField("hit_spans", SPANS, False), T.StructField("item_ids", ITEMS, False)]
    for block in _blocks(usable, block_bytes):
        if not first:
            out = stored(out, "decontaminate")
        shared = sc.broadcast(block)

        def work(shared=shared, first=first, name=uuid.uuid4().hex):
            matcher = _matcher(name, shared, width)

            def run(texts, *before):
                import pyarrow as pa

                n, spans, items = matcher.scan(texts.cast(pa.large_binary()).to_pylist())
                if not first:
                    spans = [_merged(a, b) for a, b in zip(spans, before[0].to_pylist(), strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(items, before[1].to_pylist(), strict=True)]
                return n, spans, items

            return run

        out = add_by_batch(out, [text] if first else [text, "hit_spans", "item_ids"], fields, work)
        first = False
    if first:  # no items: words are still counted
        out = add_by_batch(docs, [text], fields, lambda: lambda texts: Matcher([]).scan([x.encode() if x is not None else None for x in texts.to_pylist()]))
    return out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]))


def _merged(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            out[-1] = {"first": out[-1]["first"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Every document against every window of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_windows(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns only."""
    own, back = aside(docs, ["n_words", "hit_spans", "item_ids", "n_hit"])
    return back(find_windows(own, benchmark).where("n_hit = 0"))
