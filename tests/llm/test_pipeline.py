import __spark_entry__ as entry
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import plain  # noqa: E402


def test_queries_are_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    for k in range(1, 11):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1


def test_stages_work_on_what_is_kept(spark, tmp_path):
    clean = " ".join(f"apple{i} pear{i * 3 % 11}" for i in range(30))
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [
        (1, clean), (2, clean), (3, "too short"), (4, None), (5, clean.replace("apple3 ", "plum ")),
        (6, " ".join(f"x{i}" for i in range(60)) + " " + passage),
        (7, " ".join(f"y{i}" for i in range(60)) + "\n" + passage),
        (8, " ".join(f"z{i}" for i in range(60)) + " you idiot! you stupid moron! loser scum"),
        (9, "# $ % " * 30), (6, " ".join(f"x{i}" for i in range(60)) + " " + passage),
    ]
    docs = plain.documents(spark, rows)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept[0] == [1, 2, 5, 6, 6, 7, 8]
    assert kept[1] == [1, 2, 5, 6, 6, 7]
    assert kept[2] == [1, 6, 7]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert texts[1] == clean and passage in texts[6] and "shared" not in texts[7]
    assert set(kept[4]) == {1, 6, 7}


def test_the_pipeline_over_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_results_stay_as_they_are(spark, tmp_path):
    clean = " ".join(f"apple{i} pear{i * 3 % 11}" for i in range(30))
    rows = [(1, clean, "mine", 7, 8), (2, clean.replace("apple3 ", "plum "), None, None, 9), (2, clean.replace("apple3 ", "plum "), "b", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rejected_by string, n_words int, n_removed int")
    spark.createDataFrame([], "doc_id bigint, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "rejected_by", "n_words", "n_removed"]
    assert [tuple(r) for r in docs.collect()] == [rows[0]]
