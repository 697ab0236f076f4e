"""The registered queries on the smallest of the driver's tables: SQL where there is some, else brute force."""

import hashlib
import os
import zlib

import pytest

from seqsieve.llm import bpe, common
from seqsieve.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_op1(spark, texts):
    rows = QUERIES["op1_ppm"](spark, DATA).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    assert all(r.n_tokens == len((texts[r.doc_id] or "").encode().split()) + 1 and r.score < 0 and r.base_score < 0 for r in rows)


def test_op2(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    import numpy as np

    for r in QUERIES["op2_bpe"](spark, DATA).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3(spark, texts):
    rows = QUERIES["op3_mixing"](spark, DATA).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len((t or "").encode().split()) for i, t in texts.items()} and all(r.taken <= 3 * r.size for r in rows)
    sources = {}
    for r in rows:
        sources.setdefault((r.target, r.source_size), []).append(r)
    for (target, _), own in sources.items():
        assert abs(sum(r.taken for r in own) - target) <= 0.1 * target, "a source has ten documents here"


def test_op4_op5(spark, texts):
    for r in QUERIES["op4_tiff"](spark, DATA).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in QUERIES["op5_fingerprints"](spark, DATA).collect():
        text, k = texts[r.doc_id] or "", len(texts[r.doc_id] or "") // 3
        edited = text[: len(text) - k] + (texts[after[r.doc_id]] or "")[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_edited <= 1


def test_op6_op8(spark, texts):
    from tests_helpers import brute_repeats, brute_simhash

    ids = sorted(texts)
    want = dict(zip(ids, brute_repeats([(texts[i] or "").encode() for i in ids], 400), strict=True))
    for r in QUERIES["op6_substrings"](spark, DATA).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]
    rows = QUERIES["op8_simhash"](spark, DATA).collect()
    fp = {i: brute_simhash(texts[i]) for i in ids}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", root(i)) for i in ids}


def test_op7(spark, con):
    langs = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op7_langid"](spark, DATA).collect() if r.held_out]
    assert rows and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.95 * len(rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError):
        common.scratch(Session())
