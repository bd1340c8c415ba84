import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lorekeep.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "ll", "1", "22", "é", "日本", "!", "?", "\t", "\xa0", "　", "\x1c", "\x85", "​", "İ", "😀", "'ve", "\r\n"]


@pytest.mark.parametrize(("leaf", "window"), [(1, 1), (3, 1), (4, 2), (7, 5)])
def test_equals_one_pass(leaf, window):
    c = bpe.TreeBPE(RANKS, P.PATTERN, leaf, window)
    r = random.Random(leaf)
    for _ in range(1500):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        ids = c.encode(s)
        assert ids == c.encoding.encode_ordinary(s), repr(s)
        assert c.decode(ids, 3) == s.encode()


def test_operator(spark, odd, none):
    e: tiktoken.Encoding = bpe.codec(RANKS, P.PATTERN).encoding
    got = bpe.round_trip(odd, RANKS, P.PATTERN).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {"doc_id", "text", "found_", "score", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        ids = e.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back.collect())
