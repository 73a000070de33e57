import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.operators import metrics
from quarry.sources import sinks

RUN = "query_id string, doc_id string, rank int"
QRELS = "query_id string, doc_id string, relevance int"


def values(df):
    return {(r["metric"], r["k"]): r["value"] for r in df.collect()}


def test_only_queries_in_both_count(spark):
    run = spark.createDataFrame([("q1", f"d{i}", i) for i in range(1, 5)] + [("q3", "d1", 1)], RUN)
    qrels = spark.createDataFrame([("q1", "d2", 1), ("q1", "d4", 1), ("q2", "d1", 1), ("q1", "d3", 0)], QRELS)
    got = values(metrics.evaluate(run, qrels, (1, 5)))
    assert got["Recall", 5] == 1.0 and got["MRR", 5] == 0.5
    assert got["nDCG", 5] == pytest.approx(0.650921, abs=1e-6)
    assert got["Recall", 1] == got["nDCG", 1] == got["MRR", 1] == 0


def test_empty_run_gives_zero(spark):
    got = values(metrics.evaluate(spark.createDataFrame([], RUN), spark.createDataFrame([("q", "d", 1)], QRELS), (10,)))
    assert set(got.values()) == {0.0}


def test_repeated_judgements_and_hits(spark):
    run = spark.createDataFrame([("q", "d", 1), ("q", "d", 2)], RUN)
    qrels = spark.createDataFrame([("q", "d", 1), ("q", "d", 1), ("q", "e", 1)], QRELS)
    assert values(metrics.evaluate(run, qrels, (5,)))["Recall", 5] == pytest.approx(2 / 3)
    assert values(metrics.evaluate(run, qrels, (5,), distinct=True))["Recall", 5] == pytest.approx(1.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=12, unique=True), st.sets(st.integers(0, 12), min_size=1, max_size=6))
def test_against_plain_python(spark, ranked, relevant):
    run = spark.createDataFrame([("q", str(x), i) for i, x in enumerate(ranked, 1)], RUN)
    qrels = spark.createDataFrame([("q", str(x), 1) for x in relevant], QRELS)
    got, last = values(metrics.evaluate(run, qrels, (1, 3, 10))), 0
    for k in (1, 3, 10):
        hits = [i for i, x in enumerate(ranked[:k], 1) if x in relevant]
        assert got["Recall", k] == pytest.approx(len(hits) / len(relevant))
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(k, len(relevant)) + 1))
        assert got["nDCG", k] == pytest.approx(sum(1 / math.log2(i + 1) for i in hits) / ideal)
        assert got["MRR", k] == pytest.approx(1 / hits[0] if hits else 0)
        assert got["Recall", k] >= last
        last = got["Recall", k]


def test_nested(spark):
    m = spark.createDataFrame([("MRR", 10, 0.123456), ("MRR", 1, 0.5)], "metric string, k int, value double")
    assert metrics.nested(m).first()["values"] == {1: 0.5, 10: 0.1235}


def test_small_values_are_written_as_sql_writes_them(spark):
    """Below 0.001 a double's own text has an exponent."""
    duckdb = pytest.importorskip("duckdb")
    values = [0.0, 1.0, 0.5, 0.323, 0.0002, 0.0001, 0.00004, 0.00005, 0.12345, 0.00145, 0.00285, 0.000249999]
    m = spark.createDataFrame([("MRR", k, v) for k, v in enumerate(values, 1)], "metric string, k int, value double")
    said = [duckdb.execute("SELECT CAST(CAST(round(?::DOUBLE, 4) AS DOUBLE) AS VARCHAR)", [v]).fetchone()[0] for v in values]
    assert sinks.metrics_json(m).first()["json"] == "{" + ",".join(f'"{k}":{x}' for k, x in enumerate(said, 1)) + "}"


@pytest.mark.parametrize("distinct", [False, True])
def test_judgements_by_class_equal_listed_ones(spark, distinct):
    """Ids repeated in one class and in two, without a class, unknown to the run, alone in their class."""
    docs = [(i, i % 3) for i in range(20)] + [(4, 1), (5, 0), (7, 1), (8, None), (30, 9)]
    queries = [(0, 0), (4, 1), (4, 1), (5, 2), (5, 0), (8, 2), (8, None), (30, 9), (40, 1)]
    run = [(q, (q * 7 + 3 * r) % 22, r) for q in (0, 4, 5, 8, 30, 40, 50) for r in range(1, 12)] + [(0, 3, 12), (0, 3, 13)]
    listed = [(q, d, 1) for q, a in queries for d, b in docs if a is not None and a == b and q != d]
    run = spark.createDataFrame(run, "query_id long, doc_id long, rank int")
    want = metrics.per_query(run, spark.createDataFrame(listed, "query_id long, doc_id long, relevance int"), (1, 5, 100), distinct)
    got = metrics.per_query_by_class(run, spark.createDataFrame(queries, "query_id long, class int"), spark.createDataFrame(docs, "doc_id long, class int"), (1, 5, 100), distinct)
    rounded = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert rounded(got) == rounded(want)
