import random

import numpy as np

from lorekeep.llm import ngram_join as N
from lorekeep.llm.shingles import Shingler


def brute(rows, width, num, den):
    def shingles(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=120):
    r = random.Random(seed)
    rows, base = [], [[r.choice("abcdefghij") + r.choice("xyz") for _ in range(r.randint(1, 60))] for _ in range(25)]
    common = [r.choice("abcdefghij") + "q" for _ in range(40)]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(["new", "Word", "ÀÉ"])
        if r.random() < 0.3:
            w += common
        rows.append((i * 3 + 1, r.choice([" ", "\n", "\t "]).join(w)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, (width, num, den) in enumerate([(3, 90, 100), (5, 80, 100)]):
        monkeypatch.setattr(N, "LEAF", 4)
        monkeypatch.setattr(N, "FEW", 6)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.similar_documents(df, width=width, num=num, den=den, block=8).collect()}
        assert got == brute(rows, width, num, den)


def test_rows_of_one_id_are_one_node(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 6)
    r, rows = random.Random(3), corpus(4, 90)
    # ids that several texts carry, as copies, near copies or neither
    rows = [(r.randrange(60) if r.random() < 0.4 else i + 100, t) for i, (_, t) in enumerate(rows)] + [(7, ""), (8, None), (8, "a b c"), (3, "only here"), (None, "a b c")]
    got = [tuple(x) for x in N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=8).collect()]
    parts = brute(list(enumerate(t for _, t in rows)), 3, 90, 100)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        j = rows[parts[k][1]][0]
        if i is not None and j is not None and parts[k][0]:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
        # copies of a row without an id tell nothing about others
    # rows without an id link nothing, so their class must not be a bridge: there is but one, and it is the last
    want = sorted(((i, parts[k][0], find(i) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(got, key=str) == want
    a, b = "w1 w2 w3 w4 w5 w6 w7 w8", "other words that stand alone here"
    three = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in N.similar_documents(three).collect()} == {(3, 3), (5, 3)}
    assert [x.doc_id for x in N.keep_one(three).collect()] == [3]


def test_frequent_shingles_follow_the_texts(spark):
    texts = [(i, f"alpha beta gamma delta u{i} v{i} w{i}") for i in range(40)] + [(100 + i, "all of this is a copy") for i in range(20)]
    flags = np.unpackbits(N.frequent_shingles(spark.createDataFrame(texts, "id long, text string").repartition(20), 3)).astype(bool)
    s = Shingler(3)
    at = lambda t: flags[(s(t.encode()) >> np.uint64(40)).astype(np.int64)]
    assert at("alpha beta gamma delta").all() and not at("all of this is a copy").any() and not at("u1 v1 w1").any()
    assert not N.frequent_shingles(spark.createDataFrame([], "id long, text string"), 3).any()


def test_tree_finds_all_pairs():
    r = random.Random(5)
    s = Shingler(3)
    sets = [s(t.encode()) for _, t in corpus(9, 150)]
    sets = [x for x in {x.tobytes(): x for x in sets}.values() if len(x)]
    n, comp = np.array([len(x) for x in sets]), np.array([r.randrange(40) for _ in sets])
    maps = [N.bitmap(x) for x in sets]
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    whole = set(N.tree_pairs(list(range(len(sets))), n, maps, comp, np.full(len(sets), 3), 80, 100))
    few = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and N.possible(maps[i].tobytes(), int(n[i]), maps[j].tobytes(), int(n[j]), 80, 100)}
    assert true and true <= whole and true <= few and len(few) < len(sets) ** 2 / 4
    sides = np.array([1 + i % 2 for i in range(len(sets))])
    assert {p for p in true if sides[p[0]] != sides[p[1]]} <= set(N.tree_pairs(list(range(len(sets))), n, maps, comp, sides, 80, 100))


def test_odd_rows(spark, odd, none):
    got = N.similar_documents(odd.select("doc_id", "text", "score")).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[4] == (0, 4) and by[3] == (1, 3) and by[None] == (1, None) and by[5] == (2, 5)
    assert N.similar_documents(none).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_long_chain(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in N.similar_documents(df).collect()} == {0}


def test_thresholds(spark):
    import pytest

    for num, den in ((30, 100), (0, 1), (3, 2)):
        with pytest.raises(ValueError, match="threshold"):
            N.similar_documents(spark.range(0), num=num, den=den)


def test_bands_keep_all_pairs(spark):
    r = random.Random(11)
    rows = [(t, i, r.randint(1, 400), i) for t in (1, 2) for i in range(150)]
    for num, den in ((90, 100), (80, 100), (50, 100), (1, 1)):
        dealt = N._dealt(spark.createDataFrame(rows, "token long, rep long, n long, comp long"), num, den, 16).collect()
        groups = {}
        for x in dealt:
            groups.setdefault((x.token, x.band, x.i, x.j), []).append(x)
        met = {(k[0], *sorted((a.rep, b.rep))) for k, g in groups.items() for a in g for b in g if a.rep != b.rep and (a.side, b.side) in ((1, 2), (3, 3))}
        assert {(t, a, b) for t, a, na, _ in rows for u, b, nb, _ in rows if t == u and a < b and den * min(na, nb) >= num * max(na, nb)} <= met
        assert max(map(len, groups.values())) < 70 and all({x.side for x in g} in ({3}, {1, 2}, {1}, {2}) for g in groups.values())


def test_a_task_keeps_little_beside_its_batch():
    one = Shingler(3)
    for i in range(400):
        one(" ".join(f"w{i}x{k}" for k in range(1000)).encode())
        assert len(one.known) + len(one.known.old) <= 110_000
    assert N.BATCH_BYTES <= 4 << 20


def test_prefixes_read_packed_flags():
    rng = np.random.default_rng(4)
    for n in (1, 7, 300):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        flags = rng.random(1 << 24) < 0.5
        late = flags[(s >> np.uint64(40)).astype(np.int64)]
        want = np.concatenate([s[~late], s[late]])[: len(s) - (9 * len(s)) // 10 + N.asked(len(s))]
        got = N.prefix(s, np.packbits(flags), 9, 10)
        assert got[: len(want)].tolist() == want[: len(got)].tolist() and abs(len(got) - len(want)) <= 1
