import hashlib
import random
import re

from lorekeep.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, width):
    owners = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + width]), set()).add(i)
    for t in texts:
        w, hit, own = words(t), set(), set()
        for size in {len(k) for k in owners}:
            for k in range(len(w) - size + 1):
                if found := owners.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    own |= found
        yield len(w), len(hit), sorted(own)


def test_search_against_brute_force():
    r = random.Random(3)

    def text(n):
        return "".join(r.choice(["a", "B", "b", "é", "1", "ab", ".", " ", "\n", "-"]) + r.choice(["", " "]) for _ in range(r.randint(0, n)))

    for _ in range(150):
        items = [(i, text(40)) for i in range(r.randint(0, 6))]
        texts = [text(150) for _ in range(8)] + ["", items[0][1] if items else ""]
        m = D.Matcher([(i, t.encode()) for i, t in items])
        for s in m.searches:
            s.lane = r.choice([1, 3, 50])
        n, spans, own = m.scan([t.encode() for t in texts])
        got = [(a, sum(s["end"] - s["first"] for s in b), c) for a, b, c in zip(n, spans, own, strict=True)]
        assert got == list(brute(texts, items, 10))


def test_operator_in_one_and_many_passes(spark, odd, none):
    items = spark.createDataFrame([(7, "long words long words long words long words long words long"), (70, "Odd"), (None, "x"), (8, None), (9, ""), (7, "x")], "item_id long, text string")
    rows = [(i, t) for i, t in ((r.item_id, r.text) for r in items.collect()) if i is not None and t is not None]
    docs = odd.withColumnRenamed("score", "n_hit")
    want = sorted(zip([str(r.doc_id) for r in docs.collect()], brute([r.text for r in docs.collect()], rows, 10), strict=True))
    for limit in (1 << 20, 1):
        got = D.find_windows(docs, items, block_bytes=limit).collect()
        assert sorted((str(r.doc_id), (r.n_words, r.n_hit, list(r.item_ids))) for r in got) == want
    assert D.find_windows(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert D.find_windows(none, items).count() == 0
    clean = D.drop_contaminated(odd, items)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {1, 2, None, 4, 5, 7, 8}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, "a"), (9, "b c"), (3, "z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = D.op7_query(spark, str(tmp_path)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (3, 3, 2, hashlib.sha256(b"10,9").hexdigest(), True)


def test_matcher_memory():
    import tracemalloc

    r = random.Random(8)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(2000)).encode()) for i in range(200)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    m = D.Matcher(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 10 * size + (9 << 20) and len(m.owners[1]) > 300_000
