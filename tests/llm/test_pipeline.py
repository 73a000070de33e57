import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


def test_stages_and_whole_agree(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect()))


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_registered_names():
    names = entry.queries()
    assert "pipeline" in names and {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, DIR)
    found = con.execute(registry.ORACLE_SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert sorted(str(list(r)) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in found.fetchall())


def test_toxicity_query(spark):
    rows = registry.QUERIES["op7_toxicity"](spark, DIR).collect()
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_run_against_brute_force(spark):
    """The whole pipeline, stage by stage in plain Python (the fitted model is taken from the first stage's operator)."""
    import base64

    import numpy as np
    import public_tokenizers as P
    import tiktoken
    from test_exact import LOWER, WORD, groups, lines_kept, sha
    from test_jaccard import plain_shingles, similar

    from quarry.llm import toxicity

    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit(frame, spark.read.parquet(f"{DIR}/labels.parquet")))
    docs = {r["doc_id"]: r["text"] for r in frame.collect()}
    docs = {i: t for i, t in docs.items() if scorer.score(scorer.evidence(t)[0]) < 0.3}
    docs = lines_kept(list(docs.values()), list(docs))
    ids = sorted(docs)
    sets = [plain_shingles(docs[i]) for i in ids]
    roots = groups(len(ids), lambda a, b: similar(sets[a], sets[b]))
    docs = {ids[k]: docs[ids[k]] for k in range(len(ids)) if roots[k] == k}
    spoken = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = spoken(r["text"])
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    kept = {}
    for i, t in docs.items():
        w, hit = spoken(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit:
            kept[i] = t
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i, t in kept.items():
        tokens = plain.encode_ordinary(t or "")
        expected[i] = (len(tokens), sha(np.array(tokens, "<u4").tobytes()), sha((t or "").encode()))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == expected
