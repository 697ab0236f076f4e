"""Whitening, SentencePiece encoding and ranked search on small tables, against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seqsieve.llm import ranked, sentence_pieces, whitening
from seqsieve.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


# ---- whitening


@pytest.mark.parametrize("kind", ["random", "equal", "rank", "diagonal", "one", "close"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(3)
    n = {"one": 1}.get(kind, 40)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = {"equal": np.r_[[5.0] * 12, [1.0] * 28], "rank": np.r_[[9.0, 4, 1], np.zeros(37)], "close": 7 + 1e-9 * np.arange(40)}.get(kind, rng.random(n))
    a = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading_pairs(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
    assert np.allclose(got, want, atol=1e-13 * max(1, want[0]))
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-13)
    assert np.allclose(a @ vectors, vectors * got, atol=1e-12 * max(1, want[0]))


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 5], [3, 7]])
    assert whitening.deviations(x, 3, x.sum(axis=0)) == [None, None]
    assert whitening.deviations(np.array([[1 << 31, 5]]), 2, np.array([0, 10])) == [None]
    assert whitening.deviations(np.array([[1 << 30, 5]]), 2, np.array([0, 10])) == [1 << 62]


def test_whiten(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((60, 12)) * np.arange(1, 13) + 700).tolist()
    odd = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11, [1e300] * 12, [1.0] * 5]
    rows = [(i if i else None, v, 7, 1.5) for i, v in enumerate(vectors + vectors[:3] + odd)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n double").repartition(5)
    got = whitening.whiten(docs).collect()
    whole = np.array(vectors + vectors[:3])
    x = np.floor(1024 * whole).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    v = y.T @ y / n
    values, u = np.linalg.eigh(v)
    values, u = values[::-1], u[:, ::-1]
    want = y @ u[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id or 0, r.component)):
        i, k = r.vec_id or 0, r.component - 1
        assert abs(r.whitened * sign.setdefault(k, np.sign(r.whitened * want[i, k])) - want[i, k]) < 1e-9
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], total, strict=True))
        assert abs(r.explained - values[k] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9
    few = whitening.whiten(docs.filter("vec_id <= 2"))
    assert {r.component for r in few.collect()} == {1}  # two vectors vary along one line
    for none in (docs.filter("vec_id = 1"), docs.filter("false"), docs.filter("embedding is null")):
        assert whitening.whiten(none).collect() == []
        assert whitening.whiten(none).columns == few.columns


# ---- SentencePiece

HARD = [None, "", " ", "   ", "▁", "▁▁ x", "a\x00b", "<s> </s> <0x0A>\n\n", "日本語😀🏳️‍🌈 ﬁ　x", "a" * 3000, " " * 3000, "퟿\U0010ffff", " \n x", "the the the"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


def test_segment_and_decode(library):
    with open(sentence_pieces.default_model(), "rb") as f:
        model = sentence_pieces.Model(f.read())
    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice("aab  ▁\n\tthe é😀ñÑ0123<s>x") for _ in range(rnd.randint(0, 40)))
        ids = [i for c in model.chunks(text) for i in model.segment(c)]
        assert ids == library.encode(text) and model.decode(ids) == library.decode(ids)
    for _ in range(3000):  # ids that no text gives, broken bytes among them
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3), rnd.randrange(3, 259), 259, 28705, rnd.randrange(131, 259)]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_encode(spark, library, monkeypatch):
    rows = [(i if i != 3 else None, t, "b", 5, [1]) for i, t in enumerate(HARD + HARD[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, slot int, ids array<int>").repartition(3)
    path = sentence_pieces.default_model()
    got = sentence_pieces.encode(docs, path)
    assert got.columns == ["doc_id", "block", "slot", "ids"]
    want = sorted((i if i is not None else -1, library.encode(t or "")) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got.collect()) == want
    back = sentence_pieces.decoded(got, path)
    assert sorted(r.text for r in back.collect()) == sorted(library.decode(library.encode(t or "")) for t in HARD + HARD[:4])
    assert sentence_pieces.encode(docs.filter("false"), path).collect() == []


def test_small_tables(spark, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MOST_CHUNKS", 3)
    texts = [f"word{i % 7} and  {i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentence_pieces.encode(docs, sentence_pieces.default_model())
    assert {r.doc_id: r.ids for r in got.collect()} == {i: library.encode(t) for i, t in enumerate(texts)}


def test_chunks_are_segmented_once(monkeypatch):
    with open(sentence_pieces.default_model(), "rb") as f:
        model = sentence_pieces.Model(f.read())
    table, seen = sentence_pieces.Chunks(model), []
    monkeypatch.setattr(model, "segment_all", lambda c, own=model.segment_all: seen.extend(c) or own(c))
    chunks = model.chunks("the cat\nthe cat, the  cat")
    table.learn(chunks)
    table.learn(chunks)
    slots = np.array([table[c] for c in chunks])
    assert sorted(seen) == sorted(set(chunks)) and table.ids(slots).tolist() == [i for c in chunks for i in model.segment(c)]


def test_segment_all():
    with open(sentence_pieces.default_model(), "rb") as f:
        model = sentence_pieces.Model(f.read())
    rnd = random.Random(2)
    chunks = ["".join(rnd.choice("▁aabtheionsé😀\n..==") for _ in range(rnd.randint(1, 30))) for _ in range(3000)] + ["a" * 500, "😀"]
    ids, sizes = model.segment_all(chunks)
    assert np.split(ids, np.cumsum(sizes)[:-1])[17].tolist() == model.segment(chunks[17])
    assert ids.tolist() == [i for c in chunks for i in model.segment(c)]
    assert model.segment_all([])[0].tolist() == []


def test_op12(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op12_sentence_pieces"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---- ranked search


def brute_rank(docs, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(k for *_, k in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for i, c, size in own:
            m = 75 + 25 * size * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("entries,leaf,block", [(1 << 20, 1024, 10**6), (60, 2, 8)])
def test_rank(spark, monkeypatch, entries, leaf, block):
    rnd = random.Random(7)
    vocabulary = ["the", "of", "É", "日本", "x1", *(f"w{i}" for i in range(30))]
    text = lambda k: " ".join(rnd.choices(vocabulary, weights=[40, 30, 20, 9, 8, *([1] * 30)], k=k)) + "; THE-END"
    docs = [(i, text(rnd.randint(1, 60))) for i in range(300)] + [(None, "w1 w2 w3"), (900, None), (901, ""), (902, "--")]
    docs += [(1000 + i, "w4 w5 copies of one text") for i in range(60)] + [(5, "w6 again")] * 2
    items = [(i, text(5)) for i in range(12)] + [(50, None), (51, "nothing-here zzz"), (52, "w4 W4 w5"), (None, "w1 x1"), (0, "w9 w9 w8"), (52, "w4 W4 w5")]
    monkeypatch.setattr(ranked, "TREE_ENTRIES", entries)
    monkeypatch.setattr(ranked, "LEAF", leaf)
    monkeypatch.setattr(ranked.item_blocks, "__defaults__", (block,))
    table = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(4)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n int")
    got = ranked.rank(table, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_rank(docs, items)
    assert ranked.rank(table.filter("false"), asked).collect() == [] == ranked.rank(table, asked.filter("false")).collect()


def test_tree_nodes():
    rows = [[0, 1, 2], [0, 1], [0, 1, 3], [1, 2], [0, 1, 2]]
    tree = ranked.Tree(list("abcde"), np.array([5, 4, 3, 2, 1]), [np.array(r) for r in rows], [np.array([i + 1] * len(r)) for i, r in enumerate(rows)])
    nodes = sorted((int(t), int(d), int(b - a), int(f), int(m)) for t, d, a, b, f, m in zip(tree.term, tree.depth, tree.start, tree.end, tree.tf_most, tree.m_least, strict=True))
    assert nodes == [(0, 0, 4, 5, 1), (1, 0, 1, 4, 2), (1, 1, 4, 5, 1), (2, 1, 1, 4, 2), (2, 2, 2, 5, 1), (3, 2, 1, 3, 3)]
