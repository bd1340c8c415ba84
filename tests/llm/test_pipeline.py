import corpus_pipeline


def test_stages(spark, tmp_path):
    base = " ".join(f"the and of word{i} in tion" for i in range(40))
    other = " ".join(f"les que aux mot{i} par tion" for i in range(40))
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(1, base, "en"), (2, base + " end", "en"), (3, None, "en"), (4, "123 ###", "en"), (5, other, "fr"), (6, other.replace("mot", "mots") + " " + item, "fr"), (7, "the and of tion in the of and mail me@x.org tion the and", "en"), (None, other.replace("par", "sur"), "fr")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 5, 7, None} and len(got) == 4


def test_odd_rows_and_clashing_names(spark, odd, tmp_path):
    """Results of stages never replace columns of documents, whatever these are called."""
    spark.createDataFrame([(1, "not in any text of these")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["lang", "lang_pred", "score", "n_entities", "component_id", "n_words", "hit_spans", "item_ids", "n_hit", "row_", "found_", "rep", "t", "k", "y"]
    docs = odd.select("doc_id", "text", *[odd.found_.alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("score <> 'mine' or row_ <> 'mine' or k <> 'mine'").count() == 0, name
    last = corpus_pipeline.token_ids(spark, docs, str(tmp_path)).collect()
    assert len(last) == odd.count() and {r.doc_id: r.n_tokens for r in last}[1] == 0
