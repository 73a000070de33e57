"""Each operator against a brute-force version, on small corpora with nulls, copies, ties and long texts."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, decontaminate, embeddings, line_dedup, repeats, sharding, simhash, substring_dedup, suffix_dedup
from quarry.llm.components import components
from quarry.llm.repeats import Scheme

sha = lambda b: hashlib.sha256(b).hexdigest()


def corpus(seed: int, n: int = 60) -> list:
    """Random prose over few words, with copies, near copies, shared passages, empty, null and long texts."""
    r = random.Random(seed)
    vocabulary = ["la", "été", "wer", "of", "über", "ñu", "x", "tion", "Ab", "123"]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\n", ". "]) for _ in range(k))
    shared = text(90)
    out = [None, "", " \n\t", "x", text(1500), "ab" * 900]
    while len(out) < n:
        kind = r.randrange(6)
        if kind == 0 and len(out) > 8:
            out.append(r.choice(out))
        elif kind == 1 and len(out) > 8 and (t := r.choice(out)):
            at = r.randrange(len(t))
            out.append(t[:at] + "#" + t[at + 1 :])
        elif kind == 2:
            out.append(text(r.randrange(30)) + shared + text(r.randrange(30)))
        elif kind == 3:
            out.append(text(r.randrange(9)) + shared[r.randrange(80) :])
        else:
            out.append(text(r.randrange(120)))
    return out


def covered(seqs, window):
    """Which tokens lie in a window that also starts elsewhere."""
    n = Counter(s[i : i + window] for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if n[s[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("scheme", [Scheme(False, 40, 8, 7), Scheme(False, 40, 8, 1), Scheme(False, 33, 4, 30)])
def test_bytes(spark, docs, scheme):
    texts = corpus(1)
    raw = [(t or "").encode() for t in texts]
    got = {r["id"]: r for r in suffix_dedup.deduplicate(docs(texts).withColumnRenamed("doc_id", "id"), scheme).collect()}
    for i, (b, gone) in enumerate(zip(raw, covered(raw, scheme.window))):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall("1+", "".join("01"[g] for g in gone)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), sum(gone), runs, kept)


@pytest.mark.parametrize("scheme", [Scheme(True, 12, 3, 4), Scheme(True, 35, 6, 10)])
def test_words(spark, docs, scheme):
    texts = corpus(2)
    words = [tuple((t or "").encode().split()) for t in texts]
    got = {r["id"]: r for r in substring_dedup.deduplicate(docs(texts).withColumnRenamed("doc_id", "id"), scheme).collect()}
    for i, (w, gone) in enumerate(zip(words, covered(words, scheme.window))):
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), sha(kept))


def test_factors_are_copies_of_their_sources(spark, docs):
    """Every factor stands word for word at its source, elsewhere; together they are what is removed."""
    texts = corpus(12, 90)
    scheme = Scheme(True, 12, 3, 4)
    words = [tuple((t or "").encode().split()) for t in texts]
    frame = docs(texts).withColumnRenamed("doc_id", "id")
    name = {r["uid"]: r["id"] for r in frame.select("id", F.xxhash64("id", "text").alias("uid")).collect()}
    n_factors = longer = 0
    for r in substring_dedup.deduplicate(frame, scheme).collect():
        own, covered_ = words[r["id"]], set()
        for f in r["factors"]:
            source, n = words[name[f["source"]]], f["end"] - f["start"]
            assert n >= 12 and own[f["start"] : f["end"]] == source[f["source_start"] : f["source_start"] + n]
            assert (name[f["source"]], f["source_start"]) != (r["id"], f["start"])
            covered_ |= set(range(f["start"], f["end"]))
            longer += n > 12
        n_factors += len(r["factors"])
        assert len(covered_) == r["n_removed"]
    assert n_factors > 50 and longer > n_factors / 2


def test_many_small_buckets(spark, docs, monkeypatch):
    """Groups that straddle bucket boundaries are still found: a third of the texts is one text."""
    monkeypatch.setattr(repeats, "BUCKET_ROWS", 5)
    texts = corpus(3, 40) + ["one and the same text of forty bytes or so, again and again"] * 20
    raw = [(t or "").encode() for t in texts]
    scheme = Scheme(False, 40, 8, 7)
    got = {r["id"]: r["n_removed"] for r in suffix_dedup.deduplicate(docs(texts).withColumnRenamed("doc_id", "id"), scheme).collect()}
    assert got == {i: sum(g) for i, g in enumerate(covered(raw, 40))}


@pytest.mark.parametrize("words", [False, True])
def test_long_texts_in_pieces(docs, words):
    """Blocks and windows of a text taken in pieces are those of the whole."""
    r = random.Random(9)
    raw = "".join(r.choice(["la ", "été", "wer\n", "of", " ", "x "]) for _ in range(3000)).encode()
    scheme = Scheme(words, 20, 4, 6)
    whole = repeats.blocks(*repeats.tokenise([raw], words), scheme)
    for size in (64, 257, 5000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(repeats, "PIECE_BYTES", size)
            parts = list(repeats.long_blocks(raw, scheme))
            assert (repeats.long_words(raw)[0] == repeats.tokenise([raw], True)[0]).all()
        for k, v in whole.items():
            assert (np.concatenate([p[k] for p in parts]) == v).all()


def covered_long(seqs, window):
    """``covered`` for arrays of whole numbers, by two sums over each window that weigh places by powers of odd numbers."""
    sums = []
    for base in (6364136223846793005, 3202034522624059733):
        inverse = pow(base, -1, 1 << 64)
        each = []
        for x in seqs:
            up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(x), b, np.uint64)]) for b in (base, inverse))
            total = np.r_[np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(77)) * up[: len(x)])]
            each.append((total[window:] - total[:-window]) * down[: len(x) - window + 1] if len(x) >= window else np.empty(0, np.uint64))
        sums.append(np.concatenate(each))
    _, at, n = np.unique(np.column_stack(sums), axis=0, return_inverse=True, return_counts=True)
    again, out, lo = n[at] > 1, [], 0
    for x in seqs:
        k = max(0, len(x) - window + 1)
        marks = np.zeros(len(x) + 1, np.int64)
        starts = np.flatnonzero(again[lo : lo + k])
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + window, -1)
        out.append(np.cumsum(marks[:-1]) > 0)
        lo += k
    return out


@pytest.mark.parametrize("long", [False, True])
def test_registered_schemes_are_exact(spark, docs, long):
    """400 bytes and 35 words, over many texts or over two of some megabytes that share their middle."""
    r = random.Random(4)
    noise = lambda k: "".join(r.choices("abcdefghij klmnop", k=k))
    if long:
        middle = noise(1_200_000)
        texts = [noise(1_200_000) + middle + noise(1_200_000), noise(1_000_000) + middle + "#" + noise(1_100_000) + middle[:5000], None]
    else:
        texts = corpus(11, 80) + [noise(3000) for _ in range(5)]
        texts += [t[: r.randrange(len(t))] + noise(5) + t[r.randrange(len(t)) :] for t in texts if t and len(t) > 900]
        passages = [noise(n) for n in (399, 400, 401, 463, 464, 465, 900)]
        texts += [noise(r.randrange(900)) + p + noise(r.randrange(900)) for p in passages for _ in range(3)]
    frame = docs(texts).withColumnRenamed("doc_id", "id")
    raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    got = {x["id"]: x for x in suffix_dedup.deduplicate(frame).collect()}
    for i, (b, gone) in enumerate(zip(raw, covered_long(raw, 400))):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (gone.sum(), np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        assert got[i]["kept_sha256"] == sha(b[~gone].tobytes())
    number: dict = {}
    words = [(t or "").encode().split() for t in texts]
    ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
    found = {x["id"]: x for x in substring_dedup.deduplicate(frame).collect()}
    for i, (ws, gone) in enumerate(zip(words, covered_long(ids, 35))):
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (gone.sum(), sha(b" ".join(w for w, g in zip(ws, gone) if not g)))


def test_repeated_ids_and_empty_tables(spark, docs):
    scheme = Scheme(False, 10, 3, 4)
    twice = docs(["0123456789abc", "0123456789abc", "unlike it all"], [7, 7, 7]).withColumnRenamed("doc_id", "id")
    assert sorted(r["n_removed"] for r in suffix_dedup.deduplicate(twice, scheme).collect()) == [0, 13, 13]
    empty = docs([]).withColumnRenamed("doc_id", "id")
    for f in (suffix_dedup.deduplicate, substring_dedup.deduplicate, line_dedup.deduplicate):
        assert f(empty).collect() == []


def test_clashing_columns(spark):
    """Columns named like the operators' own change nothing: ops 2, 3, 4, 6, 7, 9 and 10."""
    from quarry.llm import toxicity

    texts = ["a b c " * 40, "a b c " * 40, "", None, "x"]
    plain = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    clash = plain
    for name in ("uid", "tag", "z", "found", "edges", "fp", "node", "n_words", "n_bytes", "kept", "ids", "n_tokens", "size", "shard", "slot", "_cell", "_row", "_part", "score", "predicted", "component_id", "others"):
        clash = clash.withColumn(name, F.lit("clash"))
    as_docs = lambda df: df.withColumnRenamed("id", "doc_id")
    model = toxicity.Model(weights={"a$": 1.0})
    for f in (
        suffix_dedup.deduplicate, substring_dedup.deduplicate, simhash.near_duplicates,
        lambda df: bpe.round_trip(as_docs(df)), lambda df: sharding.shard(as_docs(df), 3, 8), lambda df: toxicity.score(df, model),
    ):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(plain).collect()))
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x", 5), (2, [1.0, 0.1], "y", 6)], "vec_id long, embedding array<double>, v string, node long")
    assert {r["n_links"] for r in embeddings.near_duplicates(vectors).collect()} == {1}


def test_kernels():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 60, 1000).astype(np.uint64)
    for w in (1, 3, 369, 1000):
        assert (repeats.sliding_min(x, w) == [x[i : i + w].min() for i in range(1001 - w)]).all()
    keys = [r.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    order = repeats.multikey_order(keys)
    rows = list(zip(*(k[order].tolist() for k in keys)))
    assert rows == sorted(rows)
    tokens, starts, _ = repeats.tokenise([b"a bb\x0bccc", b"", b" bb "], True)
    assert starts.tolist() == [0, 3, 3, 4] and tokens[1] == tokens[3]


def lines_kept(texts, ids, min_lines=2, min_chars=20):
    seqs = [[(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" ")] if t is not None else [] for t in texts]
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    seen, out = set(), {}
    for k in order:
        s, gone = seqs[k], set()
        for p in range(len(s)):
            run = tuple(x for _, x in s[p : p + min_lines])
            if len(run) == min_lines:
                gone |= {i for i, _ in s[p : p + min_lines]} if run in seen else set()
                seen.add(run)
            one = (s[p][1],)
            if one in seen and len(one[0]) >= min_chars:
                gone.add(s[p][0])
            seen.add(one)
        t = texts[k]
        out[ids[k]] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("min_lines", [2, 3, 5])
def test_lines(spark, docs, min_lines):
    r = random.Random(min_lines)
    pool = [f"line {k}" for k in range(6)] + ["L" * 30, "", "  "]
    texts = [None, "", "\n\n", "line 1"] + ["\n".join(r.choice(pool) for _ in range(r.randrange(25))) for _ in range(50)]
    texts += texts[10:20]
    got = {x["id"]: x["kept"] for x in line_dedup.deduplicate(docs(texts).withColumnRenamed("doc_id", "id"), min_lines, 25).collect()}
    assert got == lines_kept(texts, list(range(len(texts))), min_lines, 25)


def test_longest_run(spark, docs):
    """Runs of any length come out whole, whatever lies before, behind and between them."""
    pool = [f"a line of its own {k}" for k in range(400)]
    runs = {n: pool[at : at + n] for n, at in ((2, 0), (3, 5), (5, 10), (8, 20), (13, 40), (31, 60), (64, 100), (100, 200))}
    texts, expected = ["\n".join(pool)], [0]
    for k, (n, run) in enumerate(runs.items()):
        texts.append("\n".join([f"before {k}", *run, f"behind {k}", *runs[2], f"end {k}"]))
        expected.append(n)
    got = {x["id"]: (x["longest_run"], x["n_runs"]) for x in line_dedup.deduplicate(docs(texts).withColumnRenamed("doc_id", "id")).collect()}
    assert got == {k: (n, 2 if k else 0) for k, n in enumerate(expected)}


def test_equal_rows_are_one_document(spark):
    """They keep and lose the same lines, and are no copies of each other."""
    df = spark.createDataFrame([(5, "a\nb"), (5, "a\nb"), (1, "c\nd"), (7, "c\nd\ne\na\nb"), (7, "c\nd\ne\na\nb")], "id long, text string")
    got = sorted((r["id"], r["kept"], r["n_removed"], r["n_runs"]) for r in line_dedup.deduplicate(df).collect())
    assert got == [(1, "c\nd", 0, 0), (5, "a\nb", 0, 0), (5, "a\nb", 0, 0), (7, "e", 4, 2), (7, "e", 4, 2)]


def test_line_dedup_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(2, "a\nb\nc", 1, "x", "y"), (1, "a\nb", 2, "x", "y"), (None, None, 3, "x", "y")], "doc_id long, text string, h int, kept string, id string")
    got = line_dedup.clean(df)
    assert got.columns == df.columns
    assert {(r["doc_id"], r["text"], r["h"], r["kept"], r["id"]) for r in got.collect()} == {(2, "c", 1, "x", "y"), (1, "a\nb", 2, "x", "y"), (None, None, 3, "x", "y")}


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash(spark, docs, limit):
    texts = corpus(5) + [" ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(299)), "ÀB c", "ÀB  c"]
    fps = [plain_fingerprint(t) for t in texts]
    roots = groups(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = {r["id"]: r for r in simhash.near_duplicates(docs(texts).withColumnRenamed("doc_id", "id"), group_limit=limit).collect()}
    assert {i: (got[i]["fp"] % (1 << 64), got[i]["component_id"]) for i in got} == {i: (fps[i], roots[i]) for i in range(len(texts))}


@pytest.mark.parametrize(("limit", "level"), [(4096, 1), (1, 1), (4096, 2)])
def test_pigeonring_loses_no_link(spark, limit, level):
    """Chains of fingerprints 4 bits apart, and 5 bits apart, which must not link."""
    r = random.Random(0)
    fps = []
    for _ in range(60):
        f = r.getrandbits(64)
        for bits in (0, 1, 2, 3, 4, 4, 4, 5, 5):
            for b in r.sample(range(64), bits):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    as_long = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(as_long(f),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(df, limit, level)).collect()}
    roots = groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    ours = [found.get(as_long(f), as_long(f)) for f in fps]
    assert len(set(zip(ours, roots))) == len(set(ours)) == len(set(roots))


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    linked = {frozenset(p) for p in pairs}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    roots = groups(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {n: nodes[k] for n, k in zip(nodes, roots)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_decontamination(spark, docs, block):
    texts = corpus(7)
    items = [(1, " ".join((texts[4] or "").split()[5:30])), (2, "la, ÉTÉ"), (3, None), (4, "!?"), (10, "not in it at all"), (2, "wer OF"), (None, "123 ab 123")]
    spoken = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for name, t in items:
        w = spoken(t)
        for k in range(len(w) - min(13, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[k : k + min(13, len(w))]), set()).add("null" if name is None else str(name))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: r for r in decontaminate._judged(decontaminate.find(docs(texts).withColumnRenamed("doc_id", "id"), bench, block_bytes=block)).collect()}
    for i, t in enumerate(texts):
        w, hit, names = spoken(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(names))
        assert got[i]["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_longest_match(spark, docs):
    item = " ".join(f"w{k}" for k in range(40))
    text = "x " + " ".join(f"w{k}" for k in range(5, 31)) + " y"
    got = decontaminate.report(docs([text]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (got["n_hit"], got["longest_match"]) == (26, 26)
    kept = decontaminate.clean(docs([text, "clean one", None]).withColumn("items", F.lit(1)), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and kept.columns == ["doc_id", "text", "items"]


def test_long_documents_with_a_hit_go(spark, docs):
    """One window in a text of thousands of words is under 5 percent of it, and enough."""
    item = " ".join(f"w{k}" for k in range(13))
    texts = ["x " * 3000 + item + " y" * 3000, "x " * 3000 + item[:-1], item, "", None]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = lambda share: sorted(r["doc_id"] for r in decontaminate.clean(docs(texts), bench, min_share=share).collect())
    assert left(0.0) == [1, 3, 4] and left(0.05) == [0, 1, 3, 4]
    assert decontaminate.clean(docs(texts), bench.limit(0)).count() == 5


@pytest.mark.parametrize("rows", [8192, 7])
def test_embeddings(spark, rows):
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 8))
    x = np.concatenate([base, base[:6] + 0.25 * r.normal(size=(6, 8)), base[:4] + 0.1 * r.normal(size=(4, 8)), 3 * base[:2], base[:1], base[:1]])
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, []]
    data = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(100 + i, v, 0) for i, v in enumerate(bad)] + [(200, [1.0, 0.0], 0), (201, [1.0, 0.1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    roots = groups(len(x), lambda i, j: near[i, j])
    got = {g["vec_id"]: (g["n_links"], g["component_id"], g["kept"]) for g in embeddings.near_duplicates(df, block_rows=rows).collect()}
    for i in range(len(x)):
        assert got[i] == (int(near[i].sum()) - 1, roots[i], roots[i] == i)
    for i in range(len(bad)):
        assert got[100 + i] == (0, 100 + i, True)
    assert got[200] == (1, 200, True) and got[201] == (1, 200, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_extreme_lengths(spark):
    """Lengths whose squares leave the range of doubles; a dense group; and rows of one task that are joined over many pairs."""
    r = np.random.default_rng(4)
    data = [(0, [1e-200, 1e-200]), (1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-310, 1e-310]), (4, [1e308, -1e308])]
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4)}
    dense = 1 + 0.01 * r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense.astype(np.float32))], "vec_id long, embedding array<float>")
    for rows in (8192, 50):
        assert {(g["n_links"], g["component_id"]) for g in embeddings.near_duplicates(df, block_rows=rows).collect()} == {(299, 0)}
        nodes = df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("w"), F.col("embedding").alias("v"))
        blocks = embeddings.blocks_for(300, spark.sparkContext.defaultParallelism, rows)
        assert embeddings.links(nodes, block_rows=rows).count() < 2 * 300 * (blocks + 1)
    root = np.arange(50)
    embeddings.join(root, np.arange(49), np.arange(1, 50))
    assert (root == 0).all()


def test_quantisation_bounds():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 24)) * r.choice([1, 1e-3, 50], size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e, n = embeddings.quantise(x)
    true, ours = x @ x.T, (q @ q.T).astype(float) * s[:, None] * s
    assert (np.abs(true - ours) <= e[:, None] * n + n[:, None] * e + e[:, None] * e + 1e-12).all()


def test_bpe_equals_the_rank_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    pool = [*"aé ñ漢😀\u0085 ‍\n\t'1²٣", "<|endoftext|>", "'ll", "  ", " word"]
    texts = [None, "", "word " * 30000, "a" * 500, "x\n" * 40000] + ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(300)]
    got = {x["doc_id"]: x for x in bpe.round_trip(docs(texts)).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
        at, starts, ends, split = 0, [], [], 0
        raw = (t or "").encode()
        for k in ids:
            to = at + len(plain.decode_single_token_bytes(k))
            inside = [p for p in (at, to) if p < len(raw) and raw[p] & 0xC0 == 0x80]
            first = next(p for p in range(at, -1, -1) if raw[p] & 0xC0 != 0x80)
            last = next(p for p in range(to, len(raw) + 1) if p == len(raw) or raw[p] & 0xC0 != 0x80)
            starts.append(len(raw[:first].decode()) if i > 4 else 0)
            ends.append(len(raw[:last].decode()) if i > 4 else 0)
            split += bool(inside)
            at = to
        assert got[i]["n_split"] == split
        assert i <= 4 or got[i]["offsets_sha256"] == sha(np.array(starts + ends, "<u4").tobytes())
    encoded = bpe.encode(docs(texts))
    back = {x["doc_id"]: x["text"] for x in bpe.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    row = encoded.filter("size(ids) > 5 and size(ids) < 100").first()
    t = texts[row["doc_id"]]
    assert row["starts"][0] == 0 and row["ends"][-1] == len(t)
    for i, a, b in zip(row["ids"], row["starts"], row["ends"]):
        assert plain.decode_single_token_bytes(i) in t[a:b].encode()


def test_partial_characters_decode(spark):
    _, _, spelled = bpe.load(*bpe.default_paths())
    ids = [i for i, b in enumerate(spelled) if b == "é".encode()[:1]]
    df = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()} == {1: "�", 2: None}
    assert len(set(bpe.byte_table().values())) == 256


def test_chat(spark):
    nasty = ["", None, "<|im_end|>", "\\", "\\<|", "<\\|", "<\\\\|", "<|im_sep|>\\n", "a\n<", "|b", "<\\n", "plain"]
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "we\n<|ird\\", None]), r.choice(nasty)) for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(99, 0, "user", "tie b"), (99, 0, "user", "tie a"), (99, 0, "user", "tie a"), (None, None, "assistant", "lone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {x["conv_id"]: x for x in chat.digest_chats(df).collect()}
    back = {x["conv_id"]: x for x in chat.parse_chats(chat.format_chats(df)).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted(((t is not None, t, ro or "", x or "") for k, t, ro, x in rows if k == c))
        said = [(ro, x) for *_, ro, x in turns]
        loss = [x for ro, x in said if ro == "assistant"]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == said
        assert back[c]["loss"] == loss
        blocks = sum(1 for k, (ro, _) in enumerate(said) if k == 0 or said[k - 1][0] != ro)
        assert back[c]["formatted"].count("<|im_start|>") == blocks == back[c]["formatted"].count("<|im_end|>")
        assert got[c]["n_turns"] == len(said) and got[c]["loss_chars"] == sum(map(len, loss))
        assert got[c]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said).encode()) and got[c]["loss_sha256"] == sha("".join(loss).encode())
    assert chat.digest_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """More turns than a slice, with long runs of one role."""
    r = random.Random(6)
    said = [(["user", "assistant"][(k // 300) % 2] if k < 1200 else r.choice(["user", "assistant"]), "".join(r.choices("ab\\\\<|é", k=r.randrange(6)))) for k in range(2600)]
    df = spark.createDataFrame([(1, k, ro, x) for k, (ro, x) in enumerate(said)], "conv_id long, turn long, role string, text string")
    back = chat.parse_chats(chat.format_chats(df)).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == said
    assert back["loss"] == [x for ro, x in said if ro == "assistant"]


def test_sharding(spark, docs):
    texts = [None, "", "é"] + [f"text {k}" * (k % 7) for k in range(500)]
    df = docs(texts)
    extra = df.unionByName(docs(["same"] * 200, [77] * 200)).unionByName(docs(["no id"] * 5, [None] * 5))
    for n in (1, 5, 24):
        got = sharding.shard(extra, n, 16).collect()
        assert len(got) == len(texts) + 205
        count = Counter(r["shard"] for r in got)
        assert set(count) <= set(range(n)) and max(count.values()) - min(count[s] for s in range(n)) <= 1
        for s in range(n):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    import zlib

    by = {r["doc_id"]: r for r in sharding.shard(df, 24).collect()}
    assert all(by[i]["size"] == len((t or "").encode()) + 8 and by[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    assert sharding.shard(df.limit(0)).count() == 0


def test_one_key_for_a_third_of_the_rows(spark, docs, monkeypatch):
    """Rows of one key and of no key, some equal in all, over several partitions: each cell is ranked without gaps."""
    monkeypatch.setattr(sharding, "SPLITS", 3)
    df = docs([f"t{k % 7}" for k in range(300)], [5] * 300).unionByName(docs(["x"] * 100, [None] * 100)).unionByName(docs([f"u{k}" for k in range(200)])).repartition(5)
    got = sharding.shard(df.withColumn("_row", F.lit(1)).withColumn("shard", F.lit("s")), 7, 16).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], __import__("zlib").crc32(r["text"].encode())) for r in df.collect())
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) - min(count[s] for s in range(7)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s])) for s in range(7))
    again = sharding.shard(df.repartition(2), 7, 16).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(tuple(r)[:5] for r in again)


def test_ring_flow():
    r = random.Random(0)
    counts = {c: r.randrange(1, 40) for c in r.sample(range(sharding.CELLS), 3000)} | {5: 20000}
    a, b = sharding.flow(counts, 24, 64), sharding.flow(counts, 25, 64)
    for placed, n in ((a, 24), (b, 25)):
        load = Counter()
        for cell, lo, hi, shard, base in sorted(placed, key=lambda x: (x[3], x[4])):
            assert base == load[shard] and hi > lo
            load[shard] += hi - lo
        assert [load[s] for s in range(n)] == sharding.capacities(sum(counts.values()), n)
        for cell, n_keys in counts.items():
            parts = sorted((lo, hi) for c, lo, hi, *_ in placed if c == cell)
            assert parts[0][0] == 0 and parts[-1][1] == n_keys and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    # limited movement: without the hot cell a new shard moves little more than its share
    del counts[5]
    where = lambda placed: {(c, k): s for c, lo, hi, s, _ in placed for k in range(lo, hi)}
    x, y = where(sharding.flow(counts, 24, 64)), where(sharding.flow(counts, 25, 64))
    assert sum(x[k] != y[k] for k in x) < 0.25 * len(x)
