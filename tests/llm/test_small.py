"""Each operator on small tables with nulls, empty texts, ties, repeats and extra columns, against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests_helpers import brute_first, brute_repeats, brute_simhash, words

from seqsieve.llm import bpe, common, fingerprints, langid, mixing, ppm, simhash, substrings, tiff, token_counts, url_filter

TEXTS = [None, "", " \t\n", "a", "The cat sat on the mat.", "The cat sat on the mat.", "the Cat  sat\non the mat", "ß é 漢字 Σ", "word " * 400, "x" * 5000, "12 34 !!", "a b", "a b c d e f g"]
DDL = "doc_id long, text string, lang string, source string, n long, word string, score double, ids string, key string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that the operators use."""
    rows = [(i if i != 9 else None, t, "en" if i % 3 else None, ["b", None, "a"][i % 3], 7, "w", 0.5, "i", "k", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[4:6], DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_flat_and_pieces():
    import pyarrow as pa

    col = pa.array(["ab", None, "", "é"]).slice(1)
    data, offsets = common.flat(col)
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 0, 2]
    batch = pa.RecordBatch.from_pydict({"t": ["aa", "b" * 50, "", "c"]})
    assert [b.num_rows for b in common.pieces(iter([batch]), "t", 10)] == [1, 1, 2]
    assert common.flat(pa.array([], pa.string()))[1].tolist() == [0]


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(60)] + [(9, 9), (500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in common.components(df).collect()} == {x: root(x) for x in parent}
    assert common.components(df.filter("false")).count() == 0
    for before in ("false", "a % 3 = 0", "true"):  # components that grow by the rest are those of all edges
        parts = common.stored(common.components(df.filter(before)), "parts")
        got = {r.node: r.component for r in common.grown(parts, df.filter(f"not ({before})")).collect()}
        assert got == {x: root(x) for x in parent}


# 1


def brute_ppm(counts, order):
    trie = defaultdict(Counter)
    spell = lambda w: b" \n" if w == ppm.END else b" " + w + b" "
    for w, c in counts.items():
        t = spell(w)
        for i in range(1, len(t) if c else 0):
            for k in range(min(i, order) + 1):
                trie[k, t[i - k : i]][t[i]] += c

    def score(w):
        t, s = spell(w), 0.0
        for i in range(1, len(t)):
            gone = set()
            for k in range(min(i, order), -1, -1):
                left = {a: n for a, n in trie[k, t[i - k : i]].items() if a not in gone}
                if left:
                    total = sum(left.values()) + len(left)
                    s += log10(left.get(t[i], len(left)) / total)
                    if t[i] in left:
                        break
                    gone |= set(left)
            else:
                s -= log10(256 - len(trie[0, b""]))
        return s

    return score


@pytest.mark.parametrize("head", [1 << 17, 2])
def test_ppm(docs, head):
    rows = docs.withColumn("train", F.col("doc_id") % 3 != 1)
    got = ppm.score_documents(rows.drop("score", "word"), "text", "train", head=head)
    table = docs.select("doc_id", "text").collect()
    learned = Counter()
    for r in table:
        if r.doc_id is not None and r.doc_id % 3 != 1:
            learned.update([*words(r.text), ppm.END])
    total, distinct, score = sum(learned.values()), len(learned), brute_ppm(learned, ppm.ORDER)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(w), sum(x in learned for x in w), total, round(sum(log10((learned[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6), round(sum(map(score, w)), 6)) for r in table for w in [[*words(r.text), ppm.END]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()) == want


def test_ppm_of_nothing(docs, none):
    assert ppm.score_documents(none.withColumn("train", F.lit(True)), "text", "train").count() == 0
    rows = ppm.score_documents(docs.withColumn("train", F.lit(None).cast("boolean")), "text", "train").collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.base_score is None and r.n_known == 0 and r.score < 0 for r in rows)


def test_ppm_probabilities_sum_to_one():
    """Over all bytes after a context, seen or not."""
    vocabulary = [b"abab", b"abc", b"b", ppm.END]
    code, _ = ppm.word_windows(vocabulary)
    base = int(code[3]) & ~255
    code = np.unique(np.concatenate((code, np.array([base | i for i in range(256)], np.uint64))))
    own = Counter(ppm.word_windows(vocabulary)[0].tolist())
    c = np.array([own[x] for x in code.tolist()])
    pairs = np.zeros((256, 256))
    np.add.at(pairs, ((code >> np.uint64(8) & np.uint64(255)).astype(int), (code & np.uint64(255)).astype(int)), c)
    s = ppm.window_scores(code, c, pairs)
    assert sum(10 ** x for k, x in zip(code.tolist(), s, strict=True) if k & ~255 == base) == pytest.approx(1)


# 2


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_is_the_librarys(docs, none, library):
    path = bpe.default_vocabulary()
    ids = bpe.encode(docs, path)
    rows = bpe.decoded(ids.withColumn("again", F.col("ids")), path).collect()
    assert len(rows) == len(TEXTS) + 2
    texts = dict(enumerate(TEXTS))
    for r in rows:
        text = texts[9 if r.doc_id is None else r.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert r.again == want and r.text == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(none, path).count() == 0


def test_bpe_keeps_a_bounded_number_of_words(library, monkeypatch):
    monkeypatch.setattr(bpe.Tokenizer, "MOST_CACHED", 50)
    tok, rnd = bpe.Tokenizer(open(bpe.default_vocabulary()).read()), random.Random(2)
    for _ in range(20):
        text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 4))) for _ in range(200))
        assert tok.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert 0 < len(tok.cache) <= 50 and len(tok.cache.older) <= 50


def test_workers_let_go_of_what_other_operators_keep(monkeypatch):
    import pyarrow as pa

    kept = {"bpe": 1}
    monkeypatch.setattr(common, "KEPT", kept)
    batch = pa.RecordBatch.from_pydict({"text": ["a", "b"]})
    assert len(list(common.pieces(iter([batch]), "text", keeps="bpe"))) == 1 and kept == {"bpe": 1}
    assert len(list(common.pieces(iter([batch]), "text"))) == 1 and kept == {}


def test_bpe_words(library):
    tok, rnd = bpe.Tokenizer(open(bpe.default_vocabulary()).read()), random.Random(1)
    labels = sorted(tok.automaton.labels.values())
    texts = ["a" * 999, "ab" * 500, "<|startoftext|>x<|endoftext|>", "<|endoftext", "ΑΣ ΣΑΣ", "İi", "e\u0301 \u1e9b\u0323", "it's we'll I'M", "\x1c\x85\u00a0x"]
    for pool in ("ab", "aeht", "!?.-=", "éèñß漢 ", "01 a's", labels):
        texts += ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert tok.encode(t) == want, t
        assert tok.decode(want) == library.decode(want, skip_special_tokens=False)


def test_automaton_accepts_what_merges_give():
    vocabulary = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aa", "ab</w>", "aab", "ba</w>"])}
    merges = [("a", "b"), ("a", "a"), ("a", "b</w>"), ("a", "ab"), ("b", "a</w>")]
    auto = bpe.Automaton(vocabulary, merges)
    rank = {m: i for i, m in enumerate(merges)}

    def merged(word):
        parts = [*word[:-1], word[-1] + bpe.WORD_END]
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    from itertools import product

    for n in range(1, 8):
        for w in product("ab", repeat=n):
            assert [auto.labels[i] for i in auto.encode("".join(w).encode())] == merged("".join(w))


# 3


def test_mix(spark, docs, none):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 60), None, rnd.choice(["a", "b", "b", "b", "b", "b", "b", "c", "d", None]), 0, "", 0.0, "", "", 0) for i in range(1500)]
    big = spark.createDataFrame(rows + rows[:50], DDL)
    got = mixing.mix(big).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(big.repartition(7)).collect()))
    sizes, by_id = Counter(), {r[0]: r for r in rows}
    for r in rows + rows[:50]:
        sizes[r[3]] += len(r[1].split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        s = by_id[r.doc_id][3]
        assert r.size == len(by_id[r.doc_id][1].split()) and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in order) and any(target[s] == 3 * sizes[s] for s in order)
    copies = Counter((r.doc_id) for r in mixing.mixed(big).collect())
    want = Counter()
    for r in got:
        if r.size:
            want[r.doc_id] += r.taken // r.size
    assert copies == +want
    assert len(mixing.mix(docs).collect()) == len(TEXTS) + 2 and mixing.mix(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(none).count() == 0


def test_pivotal_keeps_expectations(spark):
    items = spark.range(400).select(F.lit(0).alias("group"), "id", F.lit(1).cast("long").alias("n"), (F.col("id") % 9 + 1).alias("size"), F.lit(0.3).alias("copies"))
    mean = np.mean([[r.copies for r in mixing.pivotal_copies(items, seed=seed, leaf=8).orderBy("id").collect()] for seed in range(12)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.02 and mean.std() < 0.2


# 4


def test_tiff_codecs():
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 64, 700, 9000):
        for x in (rnd.randbytes(n), b"a" * n, bytes(rnd.choices(b"ab", k=n)), bytes(rnd.choices(b"the ", k=n // 2)) * 2):
            assert tiff.unpack_bits(tiff.pack_bits(x)) == x and tiff.unlzw(tiff.lzw(x)) == x
            assert b"".join(p["pixels"] for p in tiff.read_pages(tiff.text_tiff(x))) == tiff.payload(x)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{"rows": 5}, {"tile": 16}, {}])
def test_tiff_layouts(compression, predictor, layout):
    pixels = random.Random(4).randbytes(37 * 23)
    page = {"width": 37, "pixels": pixels, "compression": compression, "predictor": predictor} | layout
    got = list(tiff.read_pages(tiff.write_tiff([page, page])))
    assert [p["pixels"] for p in got] == [pixels] * 2 and got[0]["height"] == 23 and got[0]["compression"] == compression


def test_tiff_big_endian_rgb16():
    """Written out by hand: 2 x 1 pixels, 3 samples of 16 bits, predictor 2."""
    samples = [[100, 200, 300], [110, 190, 305]]
    diff = samples[0] + [(b - a) % 65536 for a, b in zip(*samples, strict=True)]
    data = struct.pack(">6H", *diff)
    tags = [(256, 3, 1, 2 << 16), (257, 3, 1, 1 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 3 << 16), (278, 3, 1, 1 << 16), (279, 4, 1, len(data)), (317, 3, 1, 2 << 16)]
    head = b"MM\0*" + struct.pack(">I", 8 + len(data))
    page = next(tiff.read_pages(head + data + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"))
    assert page["pixels"] == struct.pack("<6H", *samples[0], *samples[1]) and page["bits"] == 16


def test_tiff_pages(spark, docs, none):
    good = tiff.text_tiff(b"x" * 40_000)
    rows = [(1, good, "p"), (2, None, "p"), (3, b"", "p"), (4, b"junk", "p"), (5, good[:300], "p"), (6, good[:4] + b"\xff\xff\xff\x7f", "p")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id long, content binary, other string"), keys=["id"]).collect()
    assert [r.page for r in got if r.id == 1] == [0, 1, 2] and [r.compression for r in got if r.id == 1] == [8, 32773, 5]
    assert all(r.page is None and r.error for r in got if r.id != 1 and r.pixels is None) and {r.id for r in got} == {1, 2, 3, 4, 5, 6}
    made = tiff.page_digests(tiff.tiff_pages(tiff.texts_as_tiff(docs))).collect()
    assert len(made) == len(TEXTS) + 2
    for r in made:
        raw = (TEXTS[9 if r.doc_id is None else r.doc_id] or "").encode()
        p = tiff.payload(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({tuple(r)[1:] for r in made if r.doc_id in (4, 5)}) == 1
    assert tiff.page_digests(tiff.tiff_pages(tiff.texts_as_tiff(none))).count() == 0


# 5


def naive_chunks(text):
    """Byte by byte."""
    ends, start, h = [], 0, 0
    gear = [int(x) for x in fingerprints.GEAR]
    for i, b in enumerate(text):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        n = i + 1 - start
        mask = fingerprints.HARD if n < fingerprints.NORMAL else fingerprints.EASY
        if n >= fingerprints.MOST or n >= fingerprints.LEAST and not h & int(mask):
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(text)] if start < len(text) else [])


def test_chunks():
    rnd = random.Random(5)
    texts = [b"", b"a", b"x" * 1000, rnd.randbytes(3000), bytes(rnd.choices(b"abc de", k=2000))]
    for t, weights in zip(texts, fingerprints.chunk_weights(texts), strict=True):
        want, at = Counter(), 0
        for e in naive_chunks(t):
            want[xxhash.xxh3_64_intdigest(t[at:e]) >> 16] += e - at
            at = e
        assert weights == want
    a = bytes(rnd.choices(b"abc def", k=4000))
    w = fingerprints.chunk_weights([a, b"zz" + a, a[:2000]])
    assert fingerprints.containment(w[0], w[1]) > 0.95 and fingerprints.containment(w[2], w[0]) > 0.95
    assert fingerprints.containment({}, {}) == 1 and fingerprints.containment({}, w[0]) == 0 == fingerprints.containment(w[0], {})


def test_fingerprints(spark, docs, none):
    rnd = random.Random(6)
    rows = [(i * 3, "".join(rnd.choices("abé ", k=rnd.randint(0, 300)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint(df).collect()}
    assert len(got) == 200
    for i, (key, text) in enumerate(rows):
        nxt, k, r = rows[i - 1][1], len(text) // 3, got[key]
        edited = text[: len(text) - k] + nxt[:k]
        w = fingerprints.chunk_weights([text.encode(), edited.encode(), nxt.encode()])
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == fingerprints.printed(w[0])
        assert r.near_edited == fingerprints.containment(w[0], w[1]) and r.near_next == fingerprints.containment(w[0], w[2])
    rows = fingerprints.fingerprint(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and {r.fingerprint for r in rows if r.doc_id in (0, 1)} == {""}
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(docs.filter("doc_id = 8")).first()
    assert one.near_next == 1


# 6


@pytest.mark.parametrize(("length", "hot"), [(40, 10_000), (40, 2), (20, 10_000), (20, 0)])
def test_repeats(spark, length, hot):
    rnd = random.Random(7)
    base = ["".join(rnd.choices("abcdé ", k=rnd.randint(0, 300))) for _ in range(6)] + ["ab" * 60, "a" * 150, "", "x"]
    texts = ["".join(rnd.choice(base)[rnd.randint(0, 40) : rnd.randint(41, 300)] for _ in range(rnd.randint(0, 5))) for _ in range(200)] + [base[0]] * 3
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    rows = {r.doc_id: r for r in substrings.remove_repeats(df, length=length, hot=hot).collect()}
    want = brute_repeats([t.encode() for t in texts], length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (rows[i] for i in range(len(texts)))] == [x[:4] for x in want]
    assert [rows[i].text for i in range(len(texts))] == [x[4].decode(errors="ignore") for x in want]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeats_at_two_depths_and_first_ones_kept(spark, hot):
    rnd = random.Random(9)
    base = ["".join(rnd.choices("abc", k=rnd.randint(0, 200))) for _ in range(5)] + ["ab" * 60, "b" * 90]
    texts = ["".join(rnd.choice(base)[rnd.randint(0, 40) : rnd.randint(41, 200)] for _ in range(rnd.randint(0, 5))) for _ in range(150)] + [base[0]] * 2 + ["".join(rnd.choices("xyz", k=400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    keyed = df.select("doc_id", substrings.text_key(F.col("text")).alias("key"), "text")
    found = {bytes(r.key): r for r in substrings.repeats(keyed.select("key", "text"), (20, 37), hot).collect()}
    for t, short, long in zip(texts, brute_repeats([t.encode() for t in texts], 20), brute_repeats([t.encode() for t in texts], 37), strict=True):
        r = found.get(hashlib.md5(t.encode()).digest())
        assert (r.n_shared, r.n_removed, r.n_spans, bytes(r.kept)) == (short[1], long[1], long[2], long[4]) if r else short[1] == 0
    rows = {r.doc_id: r.text for r in substrings.remove_repeats(df, length=20, hot=hot, keep_first=True).collect()}
    want = brute_first([t.encode() for t in texts], 20)
    assert [rows[i] for i in range(len(texts))] == [want[t.encode()].decode() for t in texts]


def test_repeats_of_odd_tables(docs, none):
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and [r.text for r in rows if r.doc_id == 0] == [None]
    assert [r.text for r in rows if r.doc_id in (8, None)] == ["", ""] and substrings.remove_repeats(none).count() == 0


def test_gram_ids():
    data = np.frombuffer(random.Random(8).randbytes(300) * 2, np.uint8)
    for q in (1, 10, 20, 25, 50, 200):
        ids = substrings.gram_ids(data, q)
        grams = [bytes(data[i : i + q]) for i in range(len(data) - q + 1)]
        assert len(ids) == len(grams) and len(set(ids.tolist())) == len(set(grams)) and all(ids[i] == ids[i + 300] for i in range(0, 300 - q, 7))


# 7


def test_langid(spark, docs, none):
    rnd = random.Random(9)
    make = lambda pool: " ".join("".join(rnd.choices(pool, k=rnd.randint(2, 4))) for _ in range(rnd.randint(5, 60)))
    pools = {"xx": ["ka", "lo", "mi"], "yy": ["the", "sch", "ung"], "zz": ["é", "ou", "ñ"]}
    rows = [(i, make(pools[lang]), lang) for i, lang in enumerate(sorted(pools) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df.filter("doc_id < 120"))
    got = {r.doc_id: r for r in langid.predict(df, net).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i >= 120]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.label_positions(net, rows[0][1]).count("xx") > 0.8 * len(rows[0][1].encode())
    odd = langid.predict(docs, net).collect()
    assert len(odd) == len(TEXTS) + 2 and {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 10)} == {"und"}
    assert {c: 1 for c in docs.columns if c != "score"}.keys() <= set(odd[0].__fields__)
    assert langid.fit(none) is None and langid.predict(none, net).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_langid_gradients():
    rng = np.random.default_rng(10)
    d = langid.Direction(rng.standard_normal((12, 256)), rng.standard_normal((12, 4)))
    b, mask, c = rng.integers(0, 9, (5, 3)).astype(np.uint8), np.ones((5, 3)), rng.standard_normal((5, 4, 3))
    mask[3:, 1] = 0
    saved = list(d.run(b, mask, True))
    table, back = d.train(b, mask, saved, list(c))
    loss = lambda: sum(float((h * c[t]).sum()) for t, h in enumerate(d.run(b, mask)))
    for w, g, at in ((d.back, back, (7, 2)), (d.back, back, (1, 0)), (d.table, table, (9, int(b[0, 0])))):
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=2e-2, abs=2e-3)


def test_pooled_is_a_loop_over_bytes():
    net = langid.train([b"abcab", b"xyzzy"] * 4, ["p", "q"] * 4, hidden=3, steps=15)
    text = "abc xyz é".encode()
    squash = lambda x: x / (1 + np.abs(x))

    def states(way, data):
        h, out = np.zeros(3), []
        for b in data:
            x, g = way.table[:, b].astype(float), way.back.astype(float) @ h
            z, r = 0.5 + 0.5 * squash(x[:3] + g[:3]), 0.5 + 0.5 * squash(x[3:6] + g[3:6])
            new = squash(x[6:] + r * g[6:])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    both = zip(states(net.forward, text), states(net.backward, text[::-1])[::-1], strict=True)
    logits = [net.out @ np.concatenate(x) + net.bias[:, 0] for x in both]
    want = np.mean([np.exp(x) / np.exp(x).sum() for x in logits], axis=0)
    got = langid.pooled(net, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.allclose(got[0], want, atol=1e-4)


# 8


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.fingerprint % (1 << 64) == brute_simhash(TEXTS[9 if r.doc_id is None else r.doc_id])
    by = {r.doc_id: r.component_id for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4 and by[6] == 6
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_links(spark, most):
    rnd = random.Random(11)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        fps |= {f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in rnd.sample(sorted(fps), 40)}
    fps |= {0, 1, (1 << 64) - 1, (1 << 63)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.node % (1 << 64): r.component for r in common.components(simhash.links(df, most)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f in fps:
        want[root(f)].add(f)
        groups[got.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# 9


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.b.example.com/de/?q=/en/", "x://net/es/1#y", "http://a.net?/fr/", "http://com", "http://com/", "http://Ünet/fr/", "http://notexample.com/en/", "http://example.com:80/en/", "http://a.net/fr", "://net/fr/"]
    pages = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)] + [(5, urls[5], "h", "r")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        raw, tail = rest[:n], rest[n:]
        m = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
        host, path = "".join(c.lower() if c.isascii() else c for c in raw), tail[:m]
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id or 0])
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.filter("false"), default="block").collect()} == {"block"}
    long = "a." * 100_000
    far = spark.createDataFrame([(1, f"http://{long}net/es/x"), (2, f"http://{long}example.com/en/"), (3, f"http://{long}"), (4, "http://net./es/")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filter.filter_urls(far, rules).collect()} == {1: "net/es/", 2: "example.com/en/", 3: None, 4: None}
    assert url_filter.filter_urls(pages.filter("false"), rules).count() == 0
    both = spark.createDataFrame([("block", "net", "/"), ("allow", "NET", "/"), ("block", None, "/")], "action string, host string, path string")
    assert {r.verdict for r in url_filter.filter_urls(pages.filter("page_id = 7"), both, prefix_digits=1).collect()} == {"allow"}


# 10


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_token_counts(spark, group):
    rnd = random.Random(12)
    blocks, want = [], []
    for shard in range(4):
        ids = [rnd.choice([1, 2, 3, 65535]) for _ in range(rnd.randint(0, 60))] + [5] * (shard % 2 * 37)
        raw, size = np.array(ids, "<u2").tobytes(), 2 * rnd.randint(1, 5)
        blocks += [(shard, i // size, raw[i : i + size]) for i in range(0, len(raw), size)]
        start = n = 0
        for i, x in enumerate(ids + [None]):
            if x == 65535 or x is None and i > start:
                want.append((shard, n, start, i - start))
                start, n = i + 1, n + 1
    df = spark.createDataFrame([*blocks, (9, 0, None)], "shard long, block long, payload binary").repartition(3)
    assert sorted(map(tuple, token_counts.token_counts(df, group=group).collect())) == sorted(want)
    assert token_counts.token_counts(df.filter("false")).count() == 0


def test_blocks_of_ends_only(spark):
    ends = np.full(3000, 65535, "<u2").tobytes()
    got = token_counts.token_counts(spark.createDataFrame([(0, 0, ends), (0, 1, ends)], "shard long, block long, payload binary")).collect()
    assert sorted(map(tuple, got)) == [(0, i, i, 0) for i in range(6000)]


def test_word_streams(spark, docs, tmp_path):
    blocks, order = token_counts.word_stream(docs, block=64)
    rows = order.join(token_counts.token_counts(blocks), ["shard", "ordinal"]).collect()
    want = Counter((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    ids = np.array([4, 65535, 1, 2, 65535, 65535, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    got = token_counts.token_counts(token_counts.read_token_files(spark, str(tmp_path / "a.bin"), block=4)).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens) for r in got) == [(0, 0, 1), (1, 2, 2), (2, 5, 0), (3, 6, 1)]


@pytest.mark.parametrize("most", [common.MOST_BITS, 1 << 15])
def test_rows_without_a_match_are_not_shuffled(spark, monkeypatch, most):
    """without() and among() give what joins give, for keys that are null, negative or missing too, with a full bitmap too."""
    monkeypatch.setattr(common, "MOST_BITS", most)
    monkeypatch.setattr(common, "FEW", -1)
    rows = spark.range(40_000).selectExpr("case when id % 1000 = 7 then null else id - 5000 end as k", "id as n")
    for keys in (rows.filter("k % 2 = 0").select("k"), rows.filter("k in (3, -4)").select("k"), rows.limit(0).select("k")):
        keys = common.stored(keys, "keys")
        want = sorted(r.n for r in rows.join(keys, "k", "left_anti").collect())
        assert sorted(r.n for r in common.without(rows, keys, "k").collect()) == want
        may = common.among(rows, keys, "k")
        assert sorted(r.n for r in may.join(keys, "k", "left_semi").collect()) == sorted(r.n for r in rows.join(keys, "k", "left_semi").collect())
        if most > 1 << 15:
            assert may.count() <= keys.count() + 0.1 * rows.count()
    assert may.columns == rows.columns and may.isEmpty()
