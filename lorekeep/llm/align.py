"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each byte has an owner among the tokens of A and one among those of B (arrays made by repeating token numbers over bytes).
Consecutive different owner pairs are overlaps; where both owners change at once, both tokenizers have a border, which
cuts the tokens into groups. Neither tokenizer has a token across "no white space, then a blank", so a text falls into
chunks there that are encoded and aligned by themselves, once for all that are equal.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, bound_batches, stored, table
from .token_store import Remembered, _slices

#: Blanks after white space: they begin no chunk. Python's white space holds all that both tokenizers know, and a little more.
_INNER = re.compile(r"(?<=\s) ")
#: Stands for such a blank while a text is split; no text can hold half of a surrogate pair.
_HELD = "\ud800"
#: Chunks whose alignments a worker remembers, about, before it forgets those not met lately.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Owners:
    """Tokens of two sequences over the same bytes: first and last tokens by group, and their overlaps."""

    group_a: np.ndarray  # group of each token of A
    group_b: np.ndarray
    end_a: np.ndarray  # the token of A that ends with each group
    end_b: np.ndarray
    overlaps: np.ndarray  # rows (token of A, token of B, bytes that both cover)


def owners(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Owners:
    """Aligns two sequences of tokens by their lengths in bytes (1 or more each), of equal sums."""
    a, b = np.repeat(np.arange(len(lengths_a)), lengths_a), np.repeat(np.arange(len(lengths_b)), lengths_b)
    if len(a) != len(b):
        raise ValueError("both sequences have to cover the same bytes")
    if not len(a):
        none = np.zeros(0, np.int64)
        return Owners(none, none, none, none, np.zeros((0, 3), np.int64))
    new_a, new_b = np.diff(a, prepend=-1) != 0, np.diff(b, prepend=-1) != 0
    cut = new_a & new_b
    group = np.cumsum(cut) - 1
    last = np.append(np.flatnonzero(cut)[1:] - 1, len(a) - 1)
    starts = np.flatnonzero(new_a | new_b)
    return Owners(group[new_a], group[new_b], a[last], b[last], np.stack([a[starts], b[starts], np.diff(np.append(starts, len(a)))], axis=1))


def _byte_level() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Two tokenizers by their files: a byte-level one (A, JSON) and one of pieces with byte fallback (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = _byte_level()
        with open(a_path, encoding="utf-8") as f:
            added = {t["id"] for t in json.load(f)["added_tokens"]}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if i in added else bytes(chars[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError("a piece holds a blank after something else: texts cannot be cut before blanks")
        self.blank = self.b.piece_to_id("▁")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        self.size_b = len(self.b_bytes)
        #: An id as it is written before another one of its side, at the end of A's, and at the end of a group.
        self.names = [f"{i}{c}" for i in range(max(len(self.a_bytes), self.size_b)) for c in ",|;"]
        self.name_lengths = np.array([len(x) for x in self.names])
        #: Links are packed as id of A * size of B + id of B.
        self.packed = np.dtype("<u4") if len(self.a_bytes) * self.size_b < 1 << 32 else np.dtype("<u8")
        self.known = Remembered(lambda c: self._align([c])[0], REMEMBERED)

    def chunks(self, text: str) -> list[str]:
        """The chunks of blank + text, each without its first blank."""
        t = " " + text
        if _INNER.search(t):
            return [c.replace(_HELD, " ") for c in _INNER.sub(_HELD, t).split(" ")[1:]]
        return t.split(" ")[1:]

    def encode(self, chunks: list[str]) -> tuple[list[int], list[int]]:
        """Ids of A and of B of the chunks, each after a blank, as one text: no token crosses from one to the next."""
        text = " " + " ".join(chunks)
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.blank]

    def _align(self, chunks: list[str]) -> list[tuple | None]:
        """Of each chunk: numbers of tokens of A, of B, of groups; its groups as text; its links. None where bytes differ."""
        # B gives blanks for these; what ends in white space may be cut elsewhere once a blank follows
        plain = [c for c in chunks if "▁" not in c and c and not c[-1].isspace()]
        known = dict(zip(plain, self._aligned(plain), strict=True)) if plain else {}
        return [known[c] if c in known else self._aligned([c])[0] for c in chunks]

    def _aligned(self, chunks: list[str]) -> list[tuple | None]:
        ids_a, ids_b = self.encode(chunks)
        whole = (" " + " ".join(chunks)).encode()
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) != whole or b"".join(map(self.b_bytes.__getitem__, ids_b)) != whole:
            return [None] if len(chunks) == 1 else [self._aligned([c])[0] for c in chunks]
        a, b = np.array(ids_a), np.array(ids_b)
        found = owners(self.a_lengths[a], self.b_lengths[b])
        links = (a[found.end_a] * self.size_b + b[found.end_b]).astype(self.packed)
        # tokens of both in the order of their groups, A's before B's; what follows an id tells whether its side ends
        after = np.zeros(len(a) + len(b), np.int64)
        after[found.end_a], after[len(a) + found.end_b] = 1, 2
        order = np.argsort(np.concatenate([found.group_a * 2, found.group_b * 2 + 1]), kind="stable")
        spelt = (np.concatenate([a, b]) * 3 + after)[order]
        names = "".join(map(self.names.__getitem__, spelt.tolist()))
        # borders of the chunks: in bytes, then in tokens, groups and characters of the names
        bytes_until = np.cumsum([len(c.encode()) + 1 for c in chunks])
        until = [np.searchsorted(np.cumsum(n), bytes_until) + 1 for n in (self.a_lengths[a], self.b_lengths[b])]
        groups = found.group_a[until[0] - 1] + 1
        places = np.cumsum(self.name_lengths[spelt])[until[0] + until[1] - 1]
        packed, size = links.tobytes(), self.packed.itemsize
        rows = np.stack([*until, groups, places], axis=1)
        counts = np.diff(rows[:, :3], axis=0, prepend=0).tolist()
        out, lo, at = [], 0, 0
        for (n_a, n_b, n), (_, _, hi, end) in zip(counts, rows.tolist(), strict=True):
            out.append((n_a, n_b, n, names[at : end - 1], packed[lo * size : hi * size]))
            lo, at = hi, end
        return out

    def learn(self, lists: list[list[str]]) -> None:
        """Aligns the chunks that are not known, together."""
        new = [c for c in set().union(*lists) if c not in self.known and c not in self.known.old] if lists else []
        for lo in range(0, len(new), 5_000):
            part = [c for c in new[lo : lo + 5_000] if len(c) <= 64]
            self.known.update(zip(part, self._align(part), strict=True))

    def texts(self, column: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """Of each whole text: numbers of tokens of A, of B, of groups; its groups as text; its packed links. Nothing for
        null and empty texts, and those that a tokenizer does not give back."""
        lists = [self.chunks(t) if t else [] for t in column]
        self.learn(lists)
        for own in lists:
            found = list(map(self.known.__getitem__, own))
            try:
                a, b, groups, names, links = zip(*found, strict=True)
            except (TypeError, ValueError):  # a chunk that is not given back, or none at all
                yield 0, 0, 0, "", b""
                continue
            yield sum(a), sum(b), sum(groups), ";".join(names), b"".join(links)
        self.known.trim()


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a Python worker."""
    return Aligner(a_path, b_path)


_COUNTS = [T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b", "n_groups")]


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Adds n_a, n_b, n_groups, groups (ids of A, a bar, ids of B, by group: `a1,a2|b1;a3|b2,b3`) and links (packed ids of the
    tokens that end together, id of A * size of B + id of B) for each whole text.

    Null and empty texts have no tokens, as have texts whose tokens do not give back blank + text (those with U+2581, which B
    takes for a blank): zeros, and empty groups and links. Rows stay as they are, repeated ones too; columns of the names
    added are replaced.
    """
    return _aligned(docs, a_path, b_path, text, T.StructField("groups", T.StringType(), False), lambda s: s)


def _aligned(docs: DataFrame, a_path: str, b_path: str, text: str, field: T.StructField, of) -> DataFrame:
    def work():
        own = aligner(a_path, b_path)

        def run(column):
            out: tuple[list, ...] = ([], [], [], [], [])
            for part in _slices(column):
                for a, b, groups, names, links in own.texts(part.to_pylist()):
                    for kept, x in zip(out, (a, b, groups, of(names), links), strict=True):
                        kept.append(x)
            return out

        return run

    return add_by_batch(docs, [text], [*_COUNTS, field, T.StructField("links", T.BinaryType(), False)], work)


def pair_counts(linked: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, n, best: how many links of the whole table hold an id of A and one of B, and whether no id of A has more with b.

    Of two tokens that end together, the shorter one's bytes end the longer one's. So a token meets no more ids than it has
    bytes (twice that, as B spells bytes in two ways), whatever the size of the table: the sum of all lengths bounds the rows.
    """
    import pyarrow as pa

    bound_batches(linked.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        keys, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            found, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), own.packed), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, found.astype(np.int64)]), return_inverse=True)
            ns = np.bincount(place, np.concatenate([ns, n]), len(keys)).astype(np.int64)
        size = own.size_b
        for lo in range(0, len(keys), 10_000):
            k = keys[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array((k // size).astype(np.int32)), pa.array((k % size).astype(np.int32)), pa.array(ns[lo : lo + 10_000])], names=["a", "b", "n"])

    sums = linked.select("links").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def weighed(linked: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Replaces links by n_links, n_best (links whose pair is the most frequent of its id of B, ties included) and count_sum
    (the counts of all links' pairs, added up). counts: pair_counts() of a table that holds all these links; its size is
    bounded by the vocabularies, so every task gets it."""
    found = counts.toArrow()
    a, b, n, best = (found.column(c).to_numpy() for c in ("a", "b", "n", "best"))
    shared = linked.sparkSession.sparkContext.broadcast((a, b, n, best))

    def work():
        own = aligner(a_path, b_path)
        a, b, n, best = shared.value
        keys = a.astype(np.int64) * own.size_b + b
        order = np.argsort(keys)
        keys, ns, bests = keys[order].astype(own.packed), n[order], best[order].astype(np.int64)

        def run(column):
            rows = column.to_pylist()
            sizes = np.array([len(x) for x in rows], np.int64) // own.packed.itemsize
            links = np.frombuffer(b"".join(rows), own.packed)
            different, place = np.unique(links, return_inverse=True)
            at = np.searchsorted(keys, different)[place]
            until = np.concatenate([[0], np.cumsum(sizes)])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[until])
            return sizes, total(bests[at]), total(ns[at])

        return run

    return add_by_batch(linked, ["links"], [T.StructField(c, T.LongType(), False) for c in ("n_links", "n_best", "count_sum")], work).drop("links")


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs less the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 ('' for texts without tokens),
    as aligned(), pair_counts() and weighed() define them. Texts are encoded once: the second pass reads their links."""
    digest = T.StructField("groups_sha256", T.StringType(), False)
    columns = [c for c in docs.columns if c not in (text, "links")]
    sent = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("links"))  # a result replaces the text on the way
    linked = stored(_aligned(sent, a_path, b_path, "links", digest, lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""), "aligned", compression="zstd")
    return weighed(linked, pair_counts(linked, a_path, b_path), a_path, b_path)


def op13_query(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of the byte-level vocabulary aligned with those of the pieces."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment_digests(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
