import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_offsets(lengths):
    return np.cumsum(lengths).tolist()


def plain(own, text):
    """Ids, groups and links of one whole text, from sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = sentencepiece.SentencePieceProcessor(model_file=B).encode(text)
    if not text or b"".join(own.a_bytes[i] for i in x) != (" " + text).encode() or b"".join(own.b_bytes[i] for i in y) != (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = byte_offsets([len(own.a_bytes[i]) for i in x]), byte_offsets([len(own.b_bytes[i]) for i in y])
    both = sorted(set(ends_a) & set(ends_b))
    lo, groups = 0, []
    for hi in both:
        groups.append(([i for i, e in zip(x, ends_a) if lo < e <= hi], [i for i, e in zip(y, ends_b) if lo < e <= hi]))
        lo = hi
    links = [(i, j) for i, e in zip(x, ends_a) for j, f in zip(y, ends_b) if e == f] if len(x) < 3000 else [(g[0][-1], g[1][-1]) for g in groups]
    return x, y, groups, links


def digest_rows(own, docs):
    found = [(i, *plain(own, t or "")) for i, t in docs]
    counts = Counter(k for *_, links in found for k in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    for i, x, y, groups, links in found:
        names = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (i, len(x), len(y), len(groups), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(names.encode()).hexdigest() if names else "")


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = ["", " ", "  ", "a", "a ", "a  b", " \n x", "one\n two", "<|endoftext|> <s> </s>", "▁x", "x▁ y", "日本語 text", "é́ ﬁ", "tab\tand \x00 nul", "\x1c x\x85 y", "don't we'll", "x" * 300, "　wide　space ", "ends\n", "🙂 🙂"]


@pytest.fixture(scope="module")
def own():
    return align.aligner(A, B)


def test_query_equals_plain_alignment(spark, own, tmp_path):
    docs = [*enumerate(TEXTS), (100, None), (None, "no id"), (3, "a"), (5, "the same text here"), (5, "the same text here"), (7, "long words " * 900)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = align.op13_query(spark, str(tmp_path))
    assert tuple(got.columns) == COLUMNS and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(digest_rows(own, docs), key=str)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t.,'é▁日　\x1c 1Z🙂")), max_size=25))
def test_chunks_encode_as_whole_texts(text):
    own = align.aligner(A, B)
    x, y, groups, links = plain(own, text)
    a, b, g, names, packed = next(own.texts([text]))
    assert (a, b, g) == (len(x), len(y), len(groups)) and names == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    assert [divmod(int(k), own.size_b) for k in np.frombuffer(packed, own.packed)] == links


def test_owners():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 30)
        def cut():
            ends = sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n})
            return np.diff([0, *ends])
        la, lb = cut(), cut()
        got = align.owners(la, lb)
        ends_a, ends_b = byte_offsets(la), byte_offsets(lb)
        both = sorted(set(ends_a) & set(ends_b))
        assert got.group_a.tolist() == [sum(c < e for c in both) for e in ends_a] and got.group_b.tolist() == [sum(c < e for c in both) for e in ends_b]
        assert [ends_a[i] for i in got.end_a] == both == [ends_b[i] for i in got.end_b]
        spans = lambda ends: list(zip([0, *ends[:-1]], ends))
        want = [(i, j, min(b, d) - max(a, c)) for i, (a, b) in enumerate(spans(ends_a)) for j, (c, d) in enumerate(spans(ends_b)) if min(b, d) > max(a, c)]
        assert list(map(tuple, got.overlaps.tolist())) == want
    with pytest.raises(ValueError):
        align.owners(np.array([1, 2]), np.array([2]))
    assert len(align.owners(np.zeros(0, int), np.zeros(0, int)).overlaps) == 0


def test_pairs_are_bounded_by_the_vocabularies(spark, own):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = align.pair_counts(align.aligned(docs, A, B), A, B).collect()
    for r in counts:
        a, b = own.a_bytes[r.a], own.b_bytes[r.b]
        assert a.endswith(b) or b.endswith(a)
    assert all(r.best == (r.n == max(s.n for s in counts if s.b == r.b)) for r in counts)


def test_odd_rows(spark, odd, none):
    got = align.aligned(odd, A, B)
    assert got.columns[:5] == odd.columns and got.count() == odd.count()
    rows = {r.text: r for r in got.collect()}
    assert rows[None].n_a == rows[""].n_a == 0 and rows[None].groups == "" and rows["x"].n_a == 1
    assert align.alignment_digests(odd, A, B).columns == ["doc_id", "n_tokens", "found_", "score", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert align.alignment_digests(none, A, B).count() == 0
    clash = odd.withColumnRenamed("found_", "links").withColumnRenamed("score", "n_best")
    assert align.alignment_digests(clash, A, B).where("n_best > n_links").count() == 0
