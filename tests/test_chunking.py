from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.operators import chunking
from lorekeep.operators.chunking import Splitter


def test_sizes():
    s = Splitter()
    assert s.split("x" * 799) == ["x" * 799]
    assert s.split("x" * 800) == ["x" * 800]
    assert [len(c) for c in s.split("x" * 801)] == [800, 151]
    assert s.split("  \n ") == [] and s.split(None) == [] and s.split("") == []


def test_separators():
    assert Splitter(10, 0).split("aaaa\n\nbbbb\n\ncc") == ["aaaa\n\nbbbb", "cc"]
    assert Splitter(6, 0).split("一二三。四五六。七") == ["一二三", "。四五六。七"]
    assert Splitter(7, 4).split("aa bb cc dd") == ["aa bb", "bb cc", "cc dd"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n。，x", max_size=200), st.integers(2, 30), st.integers(0, 10))
def test_properties(text, size, overlap):
    chunks = Splitter(size, min(overlap, size)).split(text)
    assert all(0 < len(c) <= size and c in text and c == c.strip() for c in chunks)
    assert "".join(text.split()) == "" or chunks
    covered, at = set(), 0
    for c in chunks:
        at = text.index(c, max(0, at - size))
        covered |= set(range(at, at + len(c)))
    assert {i for i, ch in enumerate(text) if not ch.isspace()} <= {i for c in chunks for k in range(len(text)) if text.startswith(c, k) for i in range(k, k + len(c))}


def test_index_over_pages(spark):
    pages = spark.createDataFrame([("a", 1, "second " * 200), ("a", 0, "first"), ("b", 0, None), ("c", 0, "c")], "source string, page int, page_content string")
    got = chunking.split_documents(pages, "source", 100, 10).orderBy("source", "chunk_index").collect()
    a = [r for r in got if r.source == "a"]
    assert [r.chunk_index for r in a] == list(range(len(a))) and a[0].page_content == "first" and a[1].page == 1
    assert [r.source for r in got if r.source != "a"] == ["c"]


def test_metadata_and_table_function(spark):
    df = spark.createDataFrame([("x", {"source": "old", "k": "v"}), ("y", None)], "s string, metadata map<string,string>")
    got = {r.s: r.metadata for r in chunking.with_metadata(df, {"source": "new"}).collect()}
    assert got == {"x": {"source": "new", "k": "v"}, "y": {"source": "new"}}
    assert chunking.with_metadata(df, {}) is df
    chunking.register(spark)
    assert spark.sql("SELECT chunk_index, page_content FROM VALUES ('ab cd') t(v), LATERAL chunk_text(t.v)").collect() == [(0, "ab cd")]
    assert df.select(F.size(chunking.chunk_lists(F.col("s"))).alias("n")).collect() == [(1,), (1,)]


def slow_split(text, size, overlap, separators=chunking.SEPARATORS):
    """Written apart from Splitter, by scanning characters: cut before each separator, then fill chunks one piece at a time."""
    if not text:
        return []
    chosen = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(chosen) + 1 :]
    pieces, begin, at = [], 0, 0
    while at < len(text):
        if chosen == "":
            pieces.append(text[at])
            at += 1
            begin = at
        elif text.startswith(chosen, at):
            if at > begin:
                pieces.append(text[begin:at])
            begin, at = at, at + len(chosen)
        else:
            at += 1
    if begin < len(text):
        pieces.append(text[begin:])
    out, waiting = [], []

    def fill():
        window = []
        for p in waiting:
            if window and sum(map(len, window)) + len(p) > size:
                out.append("".join(window).strip())
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        out.append("".join(window).strip())
        waiting.clear()

    for p in pieces:
        if len(p) < size:
            waiting.append(p)
        else:
            fill()
            out.extend(slow_split(p, size, overlap, finer) if finer else [p.strip()])
    fill()
    return [c for c in out if c]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n\n。！？；，x", max_size=120), st.integers(2, 25), st.integers(0, 10))
def test_against_a_slow_splitter(text, size, overlap):
    assert Splitter(size, min(overlap, size)).split(text) == slow_split(text, size, min(overlap, size))


def test_registered_query_against_the_slow_splitter(spark, tmp_path):
    import random

    import __spark_entry__

    r = random.Random(6)
    rows = [(i, "".join(r.choice(["word", " ", "\n", "\n\n", "。", "，", "longer words here ", "x" * 50]) for _ in range(r.randint(0, 400)))) for i in range(40)] + [(40, None), (41, ""), (42, "y" * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.chunk_index, x.page_content) for x in __spark_entry__.queries()["chunks_recursive"](spark, str(tmp_path)).collect())
    assert got == [(i, n, c) for i, t in rows for n, c in enumerate(slow_split(t, 800, 150))]


def test_chunks_leave_a_task_by_bounded_batches(spark, monkeypatch):
    """A text's chunks may take several batches; no batch goes to Python or back with the chunks of all texts."""
    monkeypatch.setattr(chunking, "CHARS", 3000)
    text = " ".join(f"word{i}" for i in range(2000))
    pages = spark.createDataFrame([(i, 0, t, {"k": "v"}) for i, t in enumerate([text, None, "", text[:900], "x"])], "source int, page int, page_content string, metadata map<string,string>").coalesce(1)
    got = {}
    for r in chunking.split_documents(pages, paged=False).collect():
        assert r.metadata == {"k": "v"} and r.page == 0
        got.setdefault(r.source, []).append((r.chunk_index, r.page_content))
    s = chunking.Splitter()
    assert got == {i: list(enumerate(s.split(t))) for i, t in ((0, text), (3, text[:900]), (4, "x"))}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
    plan = chunking.split_documents(pages, paged=False)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
