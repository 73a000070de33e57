import json

import pytest

from quarry import __main__ as cli
from quarry.operators import encoders, indexes, sparse
from quarry.sources import readers


def test_from_files_to_metrics(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "c.tsv").write_text("1\tred fox\n2\tblue whale\n3\tred whale\n")
    (tmp_path / "q.tsv").write_text("q1\tred\n")
    (tmp_path / "r.tsv").write_text("q1\t0\t3\t1\n")
    cli.main(["collection", "--input", f"{d}/c.tsv", "--out", f"{d}/c"])
    cli.main(["queries", "--input", f"{d}/q.tsv", "--out", f"{d}/q"])
    cli.main(["qrels", "--input", f"{d}/r.tsv", "--out", f"{d}/r"])
    cli.main(["index", "--collection", f"{d}/c", "--out", f"{d}/i"])
    cli.main(["search", "--index", f"{d}/i", "--queries", f"{d}/q", "--qrels", f"{d}/r", "--out", f"{d}/o", "--k", "2"])
    assert json.loads(spark.read.text(f"{d}/o/run_json").first()[0]) == {"q1": ["1", "3"]}
    mrr = spark.read.json(f"{d}/o/metrics").filter("metric = 'MRR'").first()["json"]
    assert json.loads(mrr)["10"] == 0.5
    cli.main(["mine", "--index", f"{d}/i", "--queries", f"{d}/q", "--qrels", f"{d}/r", "--out", f"{d}/n"])
    assert [tuple(r) for r in readers.read_triple_candidates(spark, f"{d}/n").collect()] == [("q1", "3", ["1"])]
    cli.main(["evaluate", "--run", f"{d}/o/run", "--qrels", f"{d}/r"])


def test_beir_and_dev(spark, tmp_path):
    (tmp_path / "b/qrels").mkdir(parents=True)
    (tmp_path / "b/corpus.jsonl").write_text('{"_id": "a", "text": "x"}\n')
    (tmp_path / "b/queries.jsonl").write_text('{"_id": "q", "text": "y"}\n')
    (tmp_path / "b/qrels/test.tsv").write_text("q\ta\t1\n")
    (tmp_path / "top.tsv").write_text("q\ta\ty\tx\n")
    (tmp_path / "e.jsonl").write_text('{"id": "q", "question": "y"}\n')
    (tmp_path / "eq.jsonl").write_text('{"query_id": "q", "doc_id": "a", "relevance": 0}\n')
    cli.main(["beir", "--folder", f"{tmp_path}/b", "--out", f"{tmp_path}/o"])
    assert readers.read_collection(spark, f"{tmp_path}/o/collection").first()["contents"] == "x"
    cli.main(["dev", "--input", f"{tmp_path}/top.tsv", "--out", f"{tmp_path}/dev"])
    assert json.loads(spark.read.text(f"{tmp_path}/dev").first()[0]) == {"q": ["a"]}
    cli.main(["exported", "--queries", f"{tmp_path}/e.jsonl", "--qrels", f"{tmp_path}/eq.jsonl", "--out", f"{tmp_path}/x"])
    assert readers.read_queries(spark, f"{tmp_path}/x/queries").first()["text"] == "y"


@pytest.mark.parametrize("kind", indexes.KINDS)
def test_indexes_of_every_kind(spark, tmp_path, kind):
    d = str(tmp_path)
    texts = {"1": "red fox runs", "2": "blue whale swims", "3": "red whale sleeps", "4": "green bird sings"}
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": i, "contents": t, "title": ""}) + "\n" for i, t in texts.items()))
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "q1", "text": "red fox"}) + "\n")
    (tmp_path / "r.jsonl").write_text(json.dumps({"query_id": "q1", "doc_id": "3", "relevance": 1}) + "\n")
    cli.main(["index_vectors", "--collection", f"{d}/c.jsonl", "--kind", kind, "--out", f"{d}/i", "--lists", "2"])
    cli.main(["search_vectors", "--index", f"{d}/i", "--queries", f"{d}/q.jsonl", "--qrels", f"{d}/r.jsonl", "--out", f"{d}/o", "--k", "2"])
    assert json.loads(spark.read.text(f"{d}/o/run_json").first()[0])["q1"][0] == "1"
    cli.main(["mine_vectors", "--index", f"{d}/i", "--queries", f"{d}/q.jsonl", "--qrels", f"{d}/r.jsonl", "--out", f"{d}/n", "--k", "2"])
    assert readers.read_triple_candidates(spark, f"{d}/n").first()["neg_ids"][0] == "1"
    index = indexes.load(spark, f"{d}/i")
    assert index.kind == kind
    if kind != "late":
        assert indexes.totals(index).first()["n_docs"] == 4


def test_unknown_kind_and_repeated_ids(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_id long, v array<double>")
    with pytest.raises(ValueError, match="unknown index kind"):
        indexes.write("graph", rows, f"{tmp_path}/i")
    with pytest.raises(ValueError, match="unique"):
        indexes.write("flat", rows, f"{tmp_path}/i")


def test_several_beir_folders(spark, tmp_path, capsys):
    for name in ("one", "two", "three"):
        (tmp_path / name / "qrels").mkdir(parents=True)
        (tmp_path / name / "corpus.jsonl").write_text('{"_id": "a", "text": "x"}\n')
        if name != "two":
            (tmp_path / name / "queries.jsonl").write_text('{"_id": "q", "text": "y"}\n')
        (tmp_path / name / "qrels/test.tsv").write_text("q\ta\t1\n")
    folders = [f"{tmp_path}/{name}" for name in ("one", "two", "three")]
    for flags, skipped in (([], 1), ([], 3), (["--overwrite"], 1)):
        cli.main(["beir", "--folder", *folders, "--out", f"{tmp_path}/o", *flags])
        assert capsys.readouterr().out.count("skipped") == skipped
    assert readers.read_qrels(spark, f"{tmp_path}/o/three/qrels").count() == 1


def test_answers_tokens_and_projection(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "question": "who", "answer": ["x", "y"]}\n{"id": "2", "question": "what"}\n')
    assert [tuple(r) for r in readers.read_answered(spark, f"{tmp_path}/a.jsonl").orderBy("id").collect()] == [("1", "who", ["x", "y"]), ("2", "what", [])]
    passages = spark.createDataFrame([(2, [[1.0], [2.0]]), (1, [[3.0]]), (3, None)], "pid long, vs array<array<double>>")
    assert [tuple(r) for r in readers.token_stream(passages, 1).collect()] == [(1, 0, [3.0]), (2, 0, [1.0]), (2, 1, [2.0])]
    vectors = spark.createDataFrame([(1, [3.0, 4.0, 9.0], 1), (2, [1.0, 1.0, 1.0], 0), (3, None, 1)], "id long, v array<double>, m int")
    got = encoders.project(vectors, encoders.Projection([[1, 0, 0], [0, 1, 0]]), mask="m").collect()
    assert [(r["id"], [round(x, 9) for x in r["v"]]) for r in got] == [(1, [0.6, 0.8]), (2, [0.0, 0.0])]
    assert [sparse.flops_weight(s, 0.1) for s in (0, 25_000, 50_000, 90_000)] == [0.0, 0.025, 0.1, 0.1]
