import random
from itertools import combinations

import corpus_pipeline
from quarry.llm import jaccard
from test_exact import groups


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_dedup_stage_against_brute_force(spark, docs):
    """Copies with a few words changed: similarities on both sides of 0.8, most of them beyond 4 bits of a fingerprint."""
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = [None, "", "  ", "one two", "One  two"]
    for n in (20, 60, 200):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for changes in (0, 1, 1, n // 60 + 1, n // 40 + 1, n // 20 + 1):
                copy = list(base)
                for k in r.sample(range(n), changes):
                    copy[k] = word()
                texts.append(" ".join(copy))
    # a chain whose ends are apart
    base = [word() for _ in range(100)]
    texts += [" ".join(base[k : k + 60]) for k in range(0, 40, 5)]
    sets = [plain_shingles(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if similar(sets[a], sets[b]) and sets[a] != sets[b]]
    assert len(near) > 30
    roots = groups(len(sets), lambda a, b: similar(sets[a], sets[b]))
    got = corpus_pipeline.drop_near_duplicates(spark, docs(texts), "")
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(roots))


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(3, "a b c d e", 1), (1, "a b c d e", 2), (2, "quite another text here", 3), (None, None, 4), (9, "", 5), (5, " ", 6), (1, "a b c d e", 2), (None, "alone", 7)], "doc_id long, text string, node long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["node"]) for r in got.collect()) == [(-1, 7), (1, 2), (2, 3), (5, 6)]


def test_many_texts_too_far_from_each_other(spark, docs):
    """A large group around one text: some members are near it, most share bands but are too far; the bound loses none."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base = [word() for _ in range(120)]
    texts = []
    for k in range(150):
        copy = list(base)
        for at in r.sample(range(120), 1 + k % 6):
            copy[at] = word()
        texts.append(" ".join(copy))
    sets = [plain_shingles(t) for t in texts]
    roots = groups(len(sets), lambda a, b: similar(sets[a], sets[b]))
    assert len(set(roots)) > 20
    got = {x["id"]: x["component_id"] for x in jaccard.near_duplicates(docs(texts).withColumnRenamed("doc_id", "id")).collect()}
    assert got == dict(enumerate(roots))
