import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical
from quarry.sources import readers, sinks
from quarry.streaming import search as streaming


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no long, value string")


def test_collection_fields(spark):
    got = readers.parse_collection(lines(spark, 'a\tsome "text', "b\ttext\ttitle")).collect()
    assert [tuple(r) for r in got] == [("a", 'some "text', ""), ("b", "text", "title")]
    with pytest.raises(Exception, match="expected 2 or 3 fields"):
        readers.parse_collection(lines(spark, "only one")).collect()


def test_queries_fields(spark):
    assert readers.parse_queries(lines(spark, "1\twhat")).collect()[0]["text"] == "what"
    with pytest.raises(Exception, match="expected 2 fields"):
        readers.parse_queries(lines(spark, "1\ta\tb")).collect()


def test_trec_qrels(spark):
    got = readers.parse_trec_qrels(lines(spark, "q\t0\td\t1", "q\t0\te\t0")).collect()
    assert [tuple(r) for r in got] == [("q", "d", 1)]
    with pytest.raises(Exception):
        readers.parse_trec_qrels(lines(spark, "q\t0\td\tx")).collect()


def test_beir_qrels(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t1\nq\tb\t0\nq\tc\t1.9\nq\td\t-2\nq\te\tx\nq\tf\nq\tg\tnan\nq\th\tinf\n")
    (tmp_path / "qrels/train.tsv").write_text("p\ta\t2\n")
    got = readers.read_beir_qrels(spark, str(tmp_path / "qrels")).collect()
    assert sorted(map(tuple, got)) == [("p", "a", 2), ("q", "a", 1), ("q", "c", 1)]


def test_beir_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("q\ta\t1\n")
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a", "text": "x"}\n{"id": "b", "title": "t"}\n{"text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q"}\n')
    corpus, queries, qrels = readers.read_beir(spark, str(tmp_path))
    assert sorted(map(tuple, corpus.collect())) == [("None", "y", ""), ("a", "x", ""), ("b", "", "t")]
    assert [tuple(r) for r in queries.collect()] == [("q", "")] and qrels.count() == 1


def test_last_duplicate_wins(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "x", "contents": "old", "title": ""}\n{"id": "x", "contents": "new", "title": "", "more": 1}\n')
    assert readers.read_collection(spark, str(path)).collect()[0]["contents"] == "new"
    assert readers.read_collection(spark, str(path), unique=False).count() == 2


def test_last_duplicate_wins_across_files(spark, tmp_path):
    """The order of the paths counts, not that of their sizes."""
    line = '{"id": "%s", "contents": "%s", "title": "", "text": "%s"}\n'
    small, large = tmp_path / "z.jsonl", tmp_path / "a.jsonl"
    small.write_text(line % ("x", "small", "small"))
    large.write_text("".join(line % (f"n{k}", "fill", "fill") for k in range(2000)) + line % ("x", "large", "large"))
    for a, b in ((small, large), (large, small)):
        newest = b.stem == "a" and "large" or "small"
        for read, name in ((readers.read_collection, "contents"), (readers.read_queries, "text")):
            assert read(spark, str(a), str(b)).filter("id = 'x'").first()[name] == newest


def test_numbered_qrels_follow_the_files(spark, tmp_path):
    line = '{"query_id": "q", "doc_id": "%s", "relevance": 1}\n'
    (tmp_path / "b.jsonl").write_text(line % "first")
    (tmp_path / "a.jsonl").write_text("".join(line % f"d{k}" for k in range(500)))
    rows = readers.numbered_qrels(spark, str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl"))
    assert [r["doc_id"] for r in rows.orderBy("line_no").limit(2).collect()] == ["first", "d0"]


def test_dev_files(spark, tmp_path):
    (tmp_path / "top.tsv").write_text("q1\td3\tq\tp\nq1\td1\tq\tp\nq2\td9\tq\tp\n")
    got = readers.grouped_in_order(readers.read_dev_top(spark, str(tmp_path / "top.tsv"))).collect()
    assert {r["query_id"]: r["doc_ids"] for r in got} == {"q1": ["d3", "d1"], "q2": ["d9"]}
    (tmp_path / "dev.json").write_text(json.dumps({"q1": ["b", "a"]}))
    assert [tuple(r) for r in readers.read_dev(spark, str(tmp_path / "dev.json")).orderBy("rank").collect()] == [("q1", "b", 1), ("q1", "a", 2)]


def test_jsonl_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([(1, "é", "")], "id long, contents string, title string")
    sinks.write_jsonl(docs, str(tmp_path / "c"), "id")
    assert readers.read_collection(spark, str(tmp_path / "c")).collect()[0]["contents"] == "é"
    cand = spark.createDataFrame([("q", "p", ["a", "b"])], "qid string, pos_id string, neg_ids array<string>")
    sinks.write_jsonl(cand, str(tmp_path / "t"))
    assert readers.read_triple_candidates(spark, str(tmp_path / "t")).collect()[0]["neg_ids"] == ["a", "b"]
    qrels = spark.createDataFrame([("q", "d", 0), ("q", "e", 2)], "query_id string, doc_id string, relevance int")
    sinks.write_jsonl(qrels, str(tmp_path / "q"))
    assert readers.read_qrels(spark, str(tmp_path / "q")).count() == 1 and readers.read_qrels(spark, str(tmp_path / "q"), positive=False).count() == 2
    (tmp_path / "e.jsonl").write_text('{"id": "1", "question": "why"}\n')
    assert readers.read_exported_queries(spark, str(tmp_path / "e.jsonl")).first()["text"] == "why"


def test_run_and_metrics_files(spark, tmp_path):
    run = spark.createDataFrame([(1, 9, 2), (1, 7, 1)], "query_id long, doc_id long, rank int")
    sinks.write_run(run, str(tmp_path / "run"))
    assert json.loads(spark.read.text(str(tmp_path / "run")).first()[0]) == {"1": ["7", "9"]}
    m = spark.createDataFrame([("MRR", 10, 0.5)], "metric string, k int, value double")
    sinks.write_metrics(m, str(tmp_path / "m"))
    assert json.loads(spark.read.json(str(tmp_path / "m")).first()["json"]) == {"10": 0.5}


def test_training_lines_and_count(spark):
    got = readers.parse_training(lines(spark, " q\tp\tn ")).first()
    assert (got["query"], got["positive"], got["negative"]) == ("q", "p", "n")
    assert readers.line_count(lines(spark, "a", " ", "")).first()["n"] == 1


def test_best_checkpoint(spark):
    names = spark.createDataFrame([("a-val_mrr_10=0.30.ckpt",), ("b-val_mrr_10=0.31.ckpt",), ("c-val_mrr_10=0.31.ckpt",), ("last.ckpt",)], "name string")
    assert readers.best_checkpoint(names).first()["name"].startswith("b-")
    assert readers.best_checkpoint(names.filter("name = 'last.ckpt'")).first()["name"] is None


def test_query_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "red whale")], "id long, contents string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "q1", "text": "red"}\n')
    index = lexical.build(docs)
    streaming.search_stream(streaming.query_stream(spark, str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/b.json").write_text('{"id": "q2", "text": "whale"}\n')
    streaming.search_stream(streaming.query_stream(spark, str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == {("q1", 1), ("q1", 3), ("q2", 2), ("q2", 3)}
    assert got.filter(F.col("batch") == 1).count() == 2
