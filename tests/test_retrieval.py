import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import codes as C
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import common, dense, encoders, ivf, judge, lexical, mining, multivector, sampling, sparse

VEC = "doc_id long, v array<double>"
QVEC = "query_id long, v array<double>"


def ranked(df):
    return [(r["query_id"], r["doc_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "Blue whale!"), (3, "red whale"), (4, None), (5, "")], "id long, contents string")
    index = lexical.build(docs)
    got = {r["doc_id"]: r["score"] for r in lexical.search(index, spark.createDataFrame([(0, "red RED")], "query_id long, text string"), 10).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5)), 7 / 3
    for doc, tf, dl in ((1, 2, 3), (3, 1, 2)):
        assert got[doc] == pytest.approx(2 * idf * tf / (tf + 0.82 * (1 - 0.68 + 0.68 * dl / avg)), abs=1e-8)
    assert set(got) == {1, 3}
    lexical.write(index, str(tmp_path), 2)
    again = lexical.search(lexical.load(spark, str(tmp_path)), spark.createDataFrame([(0, "red RED")], "query_id long, text string"), 10)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == got
    assert lexical.search(index, spark.createDataFrame([(0, "nothing")], "query_id long, text string"), 10).count() == 0


def test_metric_choice(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], QVEC)
    d = spark.createDataFrame([(1, [0.9, 0.0]), (2, [3.0, 3.0]), (3, None)], VEC)
    assert ranked(dense.search(q, d, 2)) == [(0, 2), (0, 1)]
    assert ranked(dense.search(q, d, 2, metric="l2")) == [(0, 1), (0, 2)]
    with pytest.raises(ValueError):
        dense.search(q, d, 2, metric="cosine")


def test_dense_blocks_ties_and_expressions_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).round(1)
    x[10] = x[11]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    q = d.filter("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    a, b = dense.search(q, d, 7), dense.search(q, d, 7, block_rows=2)
    plain = q.withColumnRenamed("v", "q").crossJoin(d).select("query_id", "doc_id", F.round(V.dot(F.col("q"), F.col("v")), 9).alias("score"))
    assert ranked(a) == ranked(b) == ranked(common.top_k(plain, ["query_id"], "score", ["doc_id"], 7))
    assert (0, 0) not in ranked(dense.search(q, d, 7, exclude_self=True))


def test_sparse(spark):
    w = spark.createDataFrame([(1, 9, 1.0), (1, 7, 2.0), (1, 5, 1.0)], "id long, token int, weight double")
    assert sorted(r["token"] for r in sparse.prune(w, 2).collect()) == [5, 7]
    logits = spark.createDataFrame([(1, 3, 1.0), (1, 3, 2.0), (1, 4, -1.0)], "id long, token int, logit double")
    assert [(r["token"], round(r["weight"], 6)) for r in sparse.activate(logits).collect()] == [(3, round(math.log(3), 6))]
    q = spark.createDataFrame([(0, 7, 1.0)], "query_id long, token int, weight double")
    post = w.withColumnRenamed("id", "doc_id")
    assert [(r["doc_id"], r["score"]) for r in sparse.search(q, post, 5).collect()] == [(1, 2.0)]
    assert sparse.rerank(spark.createDataFrame([(0, 1), (0, 2)], "query_id long, doc_id long"), q, post).orderBy("rank").collect()[1]["score"] == 0


def test_maxsim(spark):
    q = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "query_id long, pos long, v array<double>")
    d = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.5, 0.5]), (2, 0, [0.0, 2.0])], "doc_id long, pos long, v array<double>")
    got = {r["doc_id"]: r["score"] for r in multivector.search(q, d, 5).collect()}
    assert got == {1: 1.5, 2: 2.0}
    again = multivector.rerank(spark.createDataFrame([(0, 1), (0, 2)], "query_id long, doc_id long"), q, d)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == got


def test_compressed_search_takes_the_best_hit_of_each_token_then_sums(spark):
    """Two lists, codes without residual: scores are those of the centroids, by hand."""
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "centroid_id long, v array<double>")
    tokens = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [1.0, 0.0]), (7, 2, [0.0, 1.0]), (8, 0, [0.0, 1.0])], "pid long, pos long, v array<double>")
    codec = ivf.Codec([-0.5, 0.0, 0.5], [0.0, 0.0, 0.0, 0.0])
    index = ivf.build(tokens, centroids, codec)
    q = spark.createDataFrame([(3, 0, [0.75, 0.25]), (3, 1, [0.125, 0.5])], "query_id long, pos long, v array<double>")
    both = {r["doc_id"]: r["score"] for r in ivf.search(q, index, centroids, codec, 10, nprobe=2).collect()}
    assert both == {7: 0.75 + 0.5, 8: 0.25 + 0.5}
    one = {r["doc_id"]: r["score"] for r in ivf.search(q, index, centroids, codec, 10, nprobe=1).collect()}
    assert one == {7: 0.75 + 0.5, 8: 0.5}
    assert ivf.duplicate_rate(ivf.candidates(q, index, centroids, codec, 2)).first()[0] == pytest.approx(8 / 4)


def test_equal_scores_are_cut_by_id(spark):
    """Scores that differ beyond the ninth place are equal."""
    q = spark.createDataFrame([(0, [1.0, 0.0])], QVEC)
    d = spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.5 + 1e-11, 0.0]), (3, [0.5 + 2e-11, 0.0])], VEC)
    assert ranked(dense.search(q, d, 1)) == [(0, 1)] and ranked(dense.search(q, d, 2)) == [(0, 1), (0, 2)]
    post = spark.createDataFrame([(1, 4, 0.5), (2, 4, 0.5 + 1e-11), (3, 4, 0.5 + 2e-11)], "doc_id long, token int, weight double")
    assert ranked(sparse.search(spark.createDataFrame([(0, 4, 1.0)], "query_id long, token int, weight double"), post, 1)) == [(0, 1)]


def test_distance_to_itself_is_zero(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)) + 50
    x[7] = x[6] + 1e-7
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    q = d.filter("doc_id % 500 = 6").withColumnRenamed("doc_id", "query_id")
    got = dense.search(q, d, 5, metric="l2").collect()
    assert {r["query_id"]: r["score"] for r in got if r["rank"] == 1} == {k: 0.0 for k in range(6, 3000, 500)}
    for r in got:
        assert r["score"] == round(float(np.linalg.norm(x[r["query_id"]] - x[r["doc_id"]])), 9)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 6][:2] == [6, 7]


def test_sums_of_zero_are_hits(spark):
    post = spark.createDataFrame([(1, 4, 1.0), (1, 5, -1.0), (2, 6, 1.0), (3, 5, -2.0)], "doc_id long, token int, weight double")
    q = spark.createDataFrame([(0, 4, 1.0), (0, 5, 1.0)], "query_id long, token int, weight double")
    assert [(r["doc_id"], r["score"]) for r in sparse.search(q, post, 9).orderBy("rank").collect()] == [(1, 0.0), (3, -2.0)]
    rows = spark.createDataFrame([(1, [0.0, -2.0, 3.0]), (2, [0.0, 0.0, 0.0])], "id long, v array<double>")
    assert [(r["id"], r["token"], r["weight"]) for r in sparse.to_sparse(rows).collect()] == [(1, 1, -2.0), (1, 2, 3.0)]


def test_containment_of_short_and_odd_queries(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat, said the other cat"), (2, "cats"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "sat on the mat, said the other"), (3, ""), (4, None), (5, "..."), (6, "on the mat, ")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]) for r in judge.containment(asked, docs).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 4), (6, 1)}


def test_fields_and_bounds(spark):
    docs = spark.createDataFrame([(1, "Red", "fox"), (2, None, "whale")], "id long, title string, contents string")
    assert [r["contents"] for r in lexical.with_fields(docs, ("title", "contents")).orderBy("id").collect()] == ["Red fox", " whale"]
    plan = lambda df: docs.join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(common.sized(docs)) and "broadcast" not in plan(common.sized(docs, max_bytes=10))


def test_packing(spark):
    df = spark.createDataFrame([([0, 1, 2, 3],), ([3, 3, 3, 3],), ([1, 2],), ([],)], "c array<int>")
    got = [r["p"] for r in df.select(C.pack(F.col("c"), 2).alias("p")).collect()]
    assert got == [[27], [255], [96], []]
    for nbits in (1, 2, 4, 8):
        c = [i % (1 << nbits) for i in range(16)]
        one = spark.createDataFrame([(c,)], "c array<int>")
        assert one.select(C.unpack(C.pack(F.col("c"), nbits), nbits).alias("u")).first()["u"] == c


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 40, 0) + 0.4 * rng.normal(size=(480, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).cache()


def test_ann_recall_and_all_lists_are_exact(spark, clustered):
    centroids = ivf.train_centroids(clustered.withColumnRenamed("doc_id", "id"), 12)
    q = clustered.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    exact = set(ranked(dense.search(q, clustered, 10)))
    near = set(ranked(ivf.ann_search(q, clustered, centroids, 10, nprobe=4)))
    assert len(exact & near) / len(exact) >= 0.9
    assert ranked(ivf.ann_search(q, clustered, centroids, 10, nprobe=12)) == ranked(dense.search(q, clustered, 10))


def test_compressed_search_is_near_the_exact_one(spark, clustered, tmp_path):
    tokens = clustered.select(F.floor(F.col("doc_id") / 4).alias("pid"), (F.col("doc_id") % 4).alias("pos"), "v")
    centroids = ivf.train_centroids(clustered.withColumnRenamed("doc_id", "id"), 12)
    residual = ivf.residuals(ivf.assign(tokens, centroids), centroids)
    q = tokens.filter("pid % 20 = 0").select(F.col("pid").alias("query_id"), "pos", "v")
    exact = set(ranked(multivector.search(q, tokens.withColumnRenamed("pid", "doc_id"), 10)))
    # unscaled, cutoffs fitted to normalised residuals meet raw ones, as the format has it: coarser
    for least, codec in ((0.9, ivf.fit_codec(residual)), (0.9, ivf.fit_codec(residual, nbits=4, exact=False)), (0.6, ivf.fit_codec(residual, scaled=False))):
        index = ivf.build(tokens, centroids, codec)
        found = set(ranked(ivf.search(q, index, centroids, codec, 10, nprobe=6)))
        assert len(found & exact) >= least * len(exact)
    ivf.write(index, str(tmp_path / "ivf"))
    assert spark.read.parquet(str(tmp_path / "ivf")).count() == 480


def test_unit_and_pooling(spark):
    t = spark.createDataFrame([(1, 0, [3.0, 4.0], 1), (1, 1, [1.0, 0.0], 0), (2, 0, [0.0, 0.0], 0)], "id long, pos int, v array<double>, m int")
    pooled = {(r["id"], r["dim"]): r["value"] for r in V.mean_pool(t, "id", "v", "m").collect()}
    assert pooled == {(1, 0): 3.0, (1, 1): 4.0, (2, 0): 0.0, (2, 1): 0.0}
    assert ivf.unit(t.filter("id = 1 and pos = 0")).first()["v"] == [0.6, 0.8]
    assert ivf.unit(t.filter("id = 2")).first()["v"] == [0.0, 0.0]
    assert V.cls_pool(t, "id", "pos", "v").orderBy("id").first()["v"] == [3.0, 4.0]
    assert {r["id"]: r["doclen"] for r in multivector.doc_lengths(t, "id", "m").collect()} == {1: 1}


def test_text_shapes(spark):
    df = spark.createDataFrame([("One, two three",), (None,)], "t string")
    got = [r["q"] for r in df.select(T.late_query(F.col("t"), 6).alias("q")).collect()]
    assert got == [["[CLS]", "[Q]", "one", "two", "three", "[SEP]"], ["[CLS]", "[Q]", "[SEP]", "[MASK]", "[MASK]", "[MASK]"]]
    doc = df.select(T.late_doc(F.col("t"), 8).alias("d")).select(T.attention(F.col("d")).alias("a")).collect()
    assert [sum(r["a"]) for r in doc] == [6, 3]
    assert df.select(T.passage(F.lit(""), F.col("t")).alias("p")).first()["p"] == " One, two three"


def test_mining(spark):
    run = spark.createDataFrame([(1, d, r) for r, d in enumerate(["d3", "d1", "d2", "d4"], 1)] + [(2, "d1", 1), (3, "d7", 1)], "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "d1", 1, 0), (1, "d9", 1, 1), (3, "d7", 1, 2)], "query_id long, doc_id string, relevance int, line_no long")
    got = {r["query_id"]: (r["pos_id"], r["neg_ids"]) for r in mining.hard_negatives(run, qrels).collect()}
    assert got == {1: ("d1", ["d3", "d2", "d4"]), 3: ("d7", [])}
    t = mining.triples(mining.hard_negatives(run, qrels), 2, seed=0).collect()
    assert [tuple(r) for r in t] == [(1, "d1", "d2")]


def test_lookup_fails_on_unknown(spark):
    cand = spark.createDataFrame([(1, 5, 1)], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(6, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="unknown document"):
        mining.lookup(cand, docs).collect()
    assert mining.lookup(cand, docs, strict=False).count() == 0


def test_shards_and_samples(spark):
    df = spark.range(103).withColumnRenamed("id", "k").repartition(5)
    shards = [r["shard"] for r in sampling.contiguous_shard(df, "k", 4).orderBy("k").collect()]
    assert shards == [min(3, i // 25) for i in range(103)]
    assert sampling.sample(df, "k", 10).count() == 10
    assert sampling.sample_size(256) == 256 and sampling.partitions_for(256) == 256 and sampling.sample_size(10_000) == 1601
    assert [r["k"] for r in sampling.shuffled(df, "k", 1).collect()] == [r["k"] for r in sampling.shuffled(df.repartition(2), "k", 1).collect()]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "red fox ran"), (2, None)], "id long, text string")
    got = {r["id"]: r["v"] for r in encoders.encode(df, encoders.BiEncoder(encoders.HashingEncoder(8)).passage).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and not any(got[2])
    p = encoders.Projection(np.eye(2, 3))(np.array([[3.0, 4.0, 9.0], [1.0, 0.0, 0.0]]), np.array([1, 0]))
    assert p.tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_containment(spark):
    q = spark.createDataFrame([(1, "One two three four five six."), (2, "too short")], "query_id long, text string")
    d = spark.createDataFrame([(7, "xOne two three four five six. More"), (8, "one two three four five six."), (9, None), (10, "too short")], "doc_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in judge.containment(q, d).orderBy("query_id").collect()] == [(1, 7), (2, 10)]


def test_in_batch_loss(spark):
    pairs = spark.createDataFrame([(0, 0, [1.0], [1.0]), (0, 1, [0.0], [2.0])], "batch_id long, i long, q array<double>, d array<double>")
    loss = dense.in_batch_loss(dense.in_batch_scores(pairs)).first()["loss"]
    assert loss == pytest.approx(((math.log(math.e + math.e**2) - 1) + math.log(2)) / 2, abs=1e-8)
