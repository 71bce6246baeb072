import corpus_pipeline

from invented import prose


def test_stages_keep_clean_documents_and_drop_bad_ones(spark, tmp_path):
    good = [(i, prose(i, 90)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "$$$" for w in prose(i, 90).split())) for i in range(40)]
    near = [(200 + i, good[i][1] + " tail") for i in range(10)]
    secret = [(300, prose(300, 90) + " write to me@example.org"), (301, "short"), (302, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in good + bad + near + secret]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns, name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == set(range(60)) | {300}
    assert kept[300].endswith("write to [EMAIL]")
    pieces = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_empty_tables(spark, tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_tells_rows_apart(spark, tmp_path):
    one, two, three, four = (prose(i, 90) for i in range(4))
    rows = [(1, one), (1, one), (None, two), (None, two), (2, two), (None, three), (None, three + " tail"), (4, one + " tail"), (4, four), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    left = [(r["doc_id"], (r["text"] or "").removesuffix(" tail")) for r in left.collect()]
    assert sorted(left, key=str) == sorted([(1, one), (2, two), (None, three), (4, four), (None, ""), (None, "")], key=str)
