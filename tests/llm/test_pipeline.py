import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        docs = out
    assert docs.select("doc_id").join(first, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.run(spark, SF).collect()
    assert packed and {r.doc_id for r in packed} <= {r.doc_id for r in first.select("doc_id").collect()}


def test_odd_and_empty_documents(spark, tmp_path):
    """Null ids and texts, empty and long ones, repeated rows; then no document at all."""
    rows = [(i, t, "de", f"s{i % 2}", 1) for i, t in enumerate([None, "", " ", "x", "X", "word " * 3000, "a" * 50_000, "Ünï ſ İx"])] + [(3, "x", "de", "s1", 1), (None, None, None, None, None), (None, "x", "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == bool(some) and {r.doc_id for r in got} <= {r[0] for r in some}
