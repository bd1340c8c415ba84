"""Byte-level BPE as a monoid: texts are encoded by halves, and neighbours are joined around their seam."""

from __future__ import annotations

import base64
import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch

#: Characters that a leaf of the tree holds at most.
LEAF_CHARS = 1024
#: Characters on either side of a seam that the first window takes in.
WINDOW_CHARS = 24

# A character that is no white space, then one that is: no match of the splitting pattern covers both, because the only
# white space before other characters in a match is a leading blank. So every encoding has a token border between them.
# (Python also counts the separators \x1c-\x1f as white space; the pattern's engine does not.)
_SPACE = r"[^\S\x1c-\x1f]"
_CUT = re.compile(rf"(?<!{_SPACE})(?={_SPACE})")
_ENDS = re.compile(rf"(?<!{_SPACE}){_SPACE}").match


class TreeBPE:
    """Encodes and decodes by tree reduction over a rank file.

    encode() halves a text down to leaves, encodes those, and joins neighbours. A join looks for a border on each side of
    the seam that every tokenization of the text shares. The window between both borders is encoded again; tokens outside
    it cannot change, whatever stands on the other side of the seam. A window without such borders doubles, at worst up to
    the two parts as a whole (one endless word). The result is that of one pass over the whole text.
    """

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.leaf_chars, self.window_chars = max(1, leaf_chars), max(1, window_chars)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        width = self.window_chars
        while True:
            a, b = self._border_before(text, max(lo, mid - width), mid, lo), self._border_after(text, mid, min(hi, mid + width), hi)
            if a is not None and b is not None:
                break
            width *= 2
        if a == mid == b:
            left += right
            return left
        # what follows a border only depends on what follows it, so both parts have the border between tokens
        keep = len(left) - self._count_back(left, len(text[a:mid].encode()))
        skip = self._count(right, len(text[mid:b].encode()))
        del left[keep:]
        left += self.encoding.encode_ordinary(text[a:b])
        left += right[skip:] if skip else right
        return left

    @staticmethod
    def _border_before(text: str, start: int, mid: int, lo: int) -> int | None:
        """The last shared border in (start, mid]; lo once the window is the whole left part."""
        for i in range(mid, start, -1):
            if _ENDS(text, i):
                return i
        return lo if start == lo else None

    @staticmethod
    def _border_after(text: str, mid: int, end: int, hi: int) -> int | None:
        """The first shared border in [mid, end); hi once the window is the whole right part."""
        m = _CUT.search(text, mid, end)
        if m and m.start() < end:
            return m.start()
        return hi if end == hi else None

    def _count_back(self, ids: list[int], n_bytes: int) -> int:
        n = 0
        while n_bytes > 0:
            n += 1
            n_bytes -= self.lengths[ids[-n]]
        return n

    def _count(self, ids: list[int], n_bytes: int) -> int:
        n = 0
        while n_bytes > 0:
            n_bytes -= self.lengths[ids[n]]
            n += 1
        return n

    def decode(self, ids: list[int], leaf_ids: int = 4096) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) <= leaf_ids:
            return self.encoding.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf_ids) + self.decode(ids[mid:], leaf_ids)


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeBPE:
    """One codec a Python worker."""
    return TreeBPE(ranks_path, pattern, leaf_chars)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Adds the token ids of each whole text as array<int>. A null or empty text has no ids."""

    def work():
        c = codec(ranks_path, pattern, leaf_chars)
        return lambda texts: [[c.encode(t) if t else [] for t in texts.to_pylist()]]

    return add_by_batch(docs, [text], [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)], work)


def decode_ids(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the bytes that each array of ids stands for; null ids give no bytes."""

    def work():
        c = codec(ranks_path, pattern)
        return lambda column: [[c.decode(x) if x else b"" for x in column.to_pylist()]]

    return add_by_batch(tokens, [ids], [T.StructField(out, T.BinaryType(), False)], work)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: each whole text encoded, and its ids decoded again.

    The ids stay in the task, so that no row carries them; encode_texts() returns them. A null text counts as empty
    (0 tokens, both digests that of nothing). Rows are kept as they are, repeated ones too; columns of these names are
    replaced.
    """

    def work():
        c = codec(ranks_path, pattern, leaf_chars)

        def run(texts):
            counts, encoded, decoded = [], [], []
            for t in texts:
                ids = c.encode(s) if (s := t.as_py()) else []
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return counts, encoded, decoded

        return run

    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return add_by_batch(docs, [text], fields, work)


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the ranks of the public 50k vocabulary."""
    import public_tokenizers as P

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    out = round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
