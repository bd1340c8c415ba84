import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import token_store as S
from lorekeep.llm.common import scratch

FILE = P.path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "\n", "'", "'s", "'RE", "1", "22", "é", "É", "é", "́", "日本", "!", "\xa0", "\x1c", "\x85", "​", "İ", "Σ", "ΑΣ", "😀", "ſ", "'ve", "\x0b", "<|endoftext|>", "<|start", "ẞ"]


def test_words_encode_as_whole_texts():
    e, t, r = S.WordEncoder(FILE), Tokenizer.from_file(FILE), random.Random(2)
    assert e.by_word
    for _ in range(3000):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 15)))
        assert e.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        keys = np.unique(r.integers(-(2**62), 2**62, n))
        h = S.key_hash(keys, np.zeros(len(keys), bool))
        index = S.PerfectHash.build(h, np.arange(len(keys)))
        assert index.find(h).tolist() == list(range(len(keys))) and len(index.prints) == len(keys)
        others = S.key_hash(keys + 1, np.zeros(len(keys), bool))
        assert (index.find(others[~np.isin(others, h)]) >= 0).sum() <= 1


def test_store(spark, odd, none):
    t = Tokenizer.from_file(FILE)
    path = scratch(spark, "test")
    S.write_shards(odd, path, lambda: S.word_encoder(FILE).encode_batch, 2, 1, shard_tokens=50)
    got = sorted(S.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == odd.count()
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want, start = {(r.doc_id, r.text) for r in odd.collect()}, 0
    texts = {}
    for i, x in want:
        texts.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = texts[r.key][0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = S.lookup(spark, path, [5, 99, 3, None]).collect()
    assert sorted((r.key is None, r.key or 0) for r in found) == [(False, 3), (False, 5), (False, 5), (True, 0)]
    assert next(r.ids for r in found if r.key == 3) == texts[3][0]
    empty = scratch(spark, "empty")
    S.write_shards(none, empty, lambda: S.word_encoder(FILE).encode_batch, 2, 1)
    assert S.read_documents(spark, empty).count() == 0


def test_a_broken_index_fails(spark, odd):
    path, broken = scratch(spark, "whole"), scratch(spark, "broken")
    S.write_shards(odd, path, lambda: S.word_encoder(FILE).encode_batch, 2, 1)
    rows = spark.read.parquet(path).collect()
    spark.createDataFrame([(*r[:-2], bytes(len(r.prints)), r.firsts) for r in rows], spark.read.parquet(path).schema).write.parquet(broken)
    with pytest.raises(Exception, match="does not know a key"):
        S.read_documents(spark, broken).collect()


def test_far_keys_read_two_shards(spark):
    path = scratch(spark, "far")
    docs = spark.range(3000).selectExpr("id * 7 as doc_id", "concat('word ', id) as text")
    S.write_shards(docs, path, lambda: S.word_encoder(FILE).encode_batch, 2, 1, shard_tokens=100)
    shards = spark.read.parquet(path)
    assert shards.count() > 50 and S.holding(shards, [0, 2999 * 7]).count() == 2 and S.holding(shards, [None]).count() == 0
    # which ranges there are follows the number of cores: the stored keys say what each shard holds
    asked = [7 * i for i in range(0, 3000, 2)]
    keys = {(r.pid, r.seq): np.frombuffer(r.keys, "<i8").tolist() for r in shards.collect()}
    found = {(r.pid, r.seq) for r in S.holding(shards, asked).collect()}
    assert sum(map(len, keys.values())) == 3000
    assert found == {k for k, own in keys.items() if any(own[0] <= a <= own[-1] for a in asked)} >= {k for k, own in keys.items() if set(own) & set(asked)}
    t = Tokenizer.from_file(FILE)
    assert {r.key: r.ids for r in S.lookup(spark, path, [0, 2999 * 7, 1]).collect()} == {k: t.encode(f"word {k // 7}", add_special_tokens=False).ids + [1] for k in (0, 2999 * 7)}


def test_batches_encode_as_single_texts():
    import pyarrow as pa

    e, t, r = S.WordEncoder(FILE), Tokenizer.from_file(FILE), random.Random(4)
    texts = ["".join(r.choice(PARTS + ["word", "Don't.", "x!?'s", "a1b"]) for _ in range(r.randint(0, 9))) for _ in range(500)] + [None, ""]
    ids, n = e.encode_batch(pa.array(texts).slice(3))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts[3:]]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [len(p) for p in S._slices(pa.array(["aaaa", None, "b", "cccccccccc", "d"]), 5)] == [3, 1, 1]


def test_ranges_keep_the_order():
    r = np.random.default_rng(3)
    keys, nulls, hashes = r.integers(0, 5, 400), r.random(400) < 0.3, r.integers(-(2**62), 2**62, 400)
    keys[:200] = 3  # a key that half of the rows share
    p = S.Ranges(keys, nulls, hashes, 8).place(keys, nulls, hashes)
    order = np.lexsort((hashes, np.where(nulls, 0, keys), ~nulls))
    assert (np.diff(p[order]) >= 0).all() and np.bincount(p, minlength=8).max() < 100 and p.max() < 8
    none = S.Ranges(keys[:0], nulls[:0], hashes[:0], 8)
    assert none.place(keys, nulls, hashes).max() == 0
