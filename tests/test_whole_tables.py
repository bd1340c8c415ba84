import __spark_entry__


def stored(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def run(spark, name, d):
    return __spark_entry__.queries()[name](spark, d).collect()


def test_contexts_have_whole_texts_of_bounded_hits(spark, tmp_path):
    docs = [(i, f"{i} " + "long text " * 30, "en", f"s{i % 2}") for i in range(30)]
    vectors = [(i, [i / 10, 0.0]) for i in range(30)]
    d = stored(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string"), embeddings=(vectors, "vec_id long, embedding array<float>"), benchmark=([(0, "q"), (29, "q")], "item_id long, text string"))
    got = {r.qid: r.context for r in run(spark, "context_by_source", d)}
    even, odd = ("\n".join(docs[i][1] for i in range(k, 10, 2)) for k in (0, 1))
    assert set(got) == {0, 29} and got[0] == f"{even}\n\n---\n\n{odd}"


def test_catalog_has_every_paper(spark, tmp_path):
    docs = [(i, f"{i} " + "long title " * 9 + "\nbody", "en", f"s{i % 2}") for i in range(21)]
    d = stored(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string"))
    up = run(spark, "catalog_upsert", d)
    assert len(up) == 42 and {r.title for r in up} == {"New: " + t.split("\n")[0] for _, t, _, _ in docs}
    assert sum(r.category == "new" and not r.is_vectorized for r in up) == 21 and sum(r.pdf_path == "p" for r in up) == 21
    marks = run(spark, "mark_vectorized", d)
    assert len(marks) == 21 and sum(r.is_vectorized for r in marks) == 14  # divisible by two or three
    assert {r.title for r in run(spark, "titles_lookup", d)} == {t.split("\n")[0] for _, t, _, _ in docs}
    assert sorted((r.doc_id, r.batch) for r in run(spark, "append_documents", d)) == [(i, b) for i in range(21) for b in (1, 2)]
