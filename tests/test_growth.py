"""What the headline retrieval queries hold and pass on, where it once grew with pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import judge, lexical, sparse
from quarry.plans import catalogue


def made(plan):
    """The rows that each node of an executed plan put out, exchanges left out, by name."""
    while plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    m = plan.metrics().get("numOutputRows")
    found = [(plan.nodeName(), m.get().value())] if m.isDefined() else []
    for i in range(plan.children().size()):
        found += made(plan.children().apply(i))
    return found


def executed(df):
    df.collect()
    return made(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def one_label(spark, tmp_path_factory):
    """3,000 vectors of one label, 30 of them queries: 90,000 pairs."""
    path = tmp_path_factory.mktemp("tables")
    v = np.random.default_rng(1).normal(size=(3000, 8)).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def duck(one_label):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{one_label}/embeddings.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["eval_recall", "eval_mrr", "eval_ndcg", "eval_all_metrics", "metrics_nested"])
def test_metrics_by_label_list_no_pairs(spark, one_label, duck, name):
    df = catalogue.QUERIES[name](spark, one_label)
    assert max(n for _, n in executed(df)) <= 30_000  # the run has as many rows
    found = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(found)


@pytest.mark.parametrize("name", ["rerank_dense", "dense_ann_topk", "rerank_maxsim", "maxsim_compressed_topk"])
def test_no_pairs_are_joined(spark, one_label, duck, name):
    """What is a part of all pairs is multiplied in tasks; a join only looks up ids."""
    df = catalogue.QUERIES[name](spark, one_label)
    assert max([n for node, n in executed(df) if "Join" in node], default=0) <= 3000
    if name in catalogue.ORACLE_SQL:
        found = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(found)


def test_pruning_sorts_no_rows_and_equals_the_pruning_of_rows(spark):
    """Ties at the cut, texts without a token, null ones, letters beyond ASCII."""
    texts = ["b a c a", None, "", " ..", "é z É z y", "x " * 5 + "w w", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weighted = lambda df: df.select("doc_id", F.col("term").alias("token"), F.col("tf").cast("double").alias("weight"))
    got = weighted(lexical.term_counts(df, "doc_id", "text", 2))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sparse.prune(weighted(lexical.term_counts(df, "doc_id", "text")), 2, "doc_id").collect()))
    assert sorted(map(tuple, got.collect())) == [(0, "a", 2.0), (0, "b", 1.0), (4, "z", 2.0), (4, "é", 2.0), (5, "w", 2.0), (5, "x", 5.0), (6, "one", 1.0)]


def test_pruned_postings_of_the_tables_take_no_window(spark):
    plan = catalogue.QUERIES["sparse_prune_topn"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_judgements_by_text_list_no_grams(spark):
    """Grams over the edge of a text, empty pieces, repeated grams and texts, short queries; no row for each gram of a text."""
    said = ["one two three four five six", "two three four five six seven!", "Zwei drei vier fünf sechs", "short one"]
    texts = [" one two three four five six seven! ", "zero one two", "three four five six", said[0] + " " + said[0], "two  three four five six seven!", said[2], "a short one", None, ""] + ["x y z " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = judge.containment(spark.createDataFrame(list(enumerate(said)), "query_id long, text string"), docs)
    rows = executed(df)
    assert sorted((r["query_id"], r["doc_id"]) for r in df.collect()) == sorted((q, d) for q, s in enumerate(said) for d, t in enumerate(texts) if t is not None and s in t)
    assert max(n for _, n in rows) < 100
