import random
import zlib

import pytest

from quarry.llm import toxicity as T


def passages(scores):
    """All maximal scoring segments, by definition: no prefix or suffix of one sums to 0 or less, and none can grow."""
    def best(lo, hi):
        top = max(((sum(scores[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        a, b = -top[1], -top[2]
        return best(lo, a) + [(a, b)] + best(b, hi)

    return best(0, len(scores))


def test_segments_are_the_maximal_ones():
    r = random.Random(0)
    for _ in range(200):
        weights = {f"{chr(97 + k)}$": w for k, w in enumerate(r.sample([0.5, 1.25, 2.0, 3.5, 0.75, 4.0], 4))}
        scorer = T.Scorer(T.Model(weights=weights, drift=-0.875))
        ws = [r.choice("abcdzzzz") for _ in range(r.randrange(14))]
        scores = [weights.get(f"{w}$", -0.875) for w in ws]
        got = scorer.segments(ws)
        assert sum(s for *_, s in got) == pytest.approx(sum(sum(scores[a:b]) for a, b in passages(scores)))
        for lo, hi, s in got:
            assert s == pytest.approx(sum(scores[lo:hi])) and scores[lo] > 0 and scores[hi - 1] > 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [r.choice(words) for _ in range(r.randrange(20, 200))]
        if toxic:
            for at in r.sample(range(len(text)), 5):
                text[at] = r.choice(["vile", "vilest", "NASTY!", "foulish"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "...")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark, labelled):
    docs, labels, truth = labelled
    model = T.fit(docs, labels)
    got = {r["id"]: r for r in T.score(docs.withColumnRenamed("doc_id", "id"), model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(got[i]["predicted"] == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["predicted"] == got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert any(r["n_passages"] and r["passages"][0]["end"] > r["passages"][0]["start"] for r in got.values())


def test_documents_without_a_significant_segment_are_ranked():
    """The nearer the best segment comes to significance, the higher the score; it never passes a significant one."""
    model = T.Model(weights={"bad$": 1.0, "worse$": 4.0}, drift=-0.5, rate=1.0, slope=2.0, below=1.5, level=-1.0)
    scorer = T.Scorer(model)
    plain = " plain" * 200
    got = [scorer.score(scorer.evidence(t)[0]) for t in (plain, "bad" + plain, "bad bad" + plain, "worse worse" + plain)]
    assert got == sorted(set(got)) and scorer.evidence(plain)[0] == -1.0 and scorer.evidence(None)[0] == -1.0
    assert [bool(scorer.evidence(t)[1]) for t in (plain, "bad bad" + plain, "worse worse" + plain)] == [False, False, True]


def test_labels_of_held_out_rows_are_not_learned(spark, labelled):
    docs, labels, _ = labelled
    chosen = T.training_rows(labels).collect()
    assert chosen and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in chosen)
    assert T.training_rows(labels, 100).count() <= 130


def test_without_labels_and_empty(spark, labelled):
    docs, labels, _ = labelled
    none = T.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in T.score(docs.withColumnRenamed("doc_id", "id"), none).collect()} == {0}
    assert T.score(docs.limit(0).withColumnRenamed("doc_id", "id"), none).count() == 0


def test_keep_clean_keeps_columns(spark, labelled):
    docs, labels, _ = labelled
    wide = docs.selectExpr("doc_id", "text", "1 as score", "2 as id")
    kept = T.keep_clean(wide, T.fit(docs, labels))
    assert kept.columns == wide.columns and 740 <= kept.count() <= 770
