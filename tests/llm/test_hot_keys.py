"""Keys that hold much of a table, files of many blocks: results whole, no bucket or task that holds them all."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from seqsieve.llm import fingerprints, token_counts
from seqsieve.llm.token_counts import END


def test_fingerprints_of_hot_and_null_ids(spark):
    rnd = random.Random(2)
    text = lambda: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(rnd.randint(0, 30)))
    rows = [(k, text()) for k in [7, None] * 400 + list(range(-200, 200)) + [-(1 << 63), (1 << 63) - 1]] + [(7, None), (None, "")] * 3
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    order = docs.orderBy(F.col("doc_id").desc_nulls_last(), h, "text").collect()
    want = []
    for i, r in enumerate(order):
        own, following = r.text or "", order[(i + 1) % len(order)].text or ""
        k = len(own) // 3
        want.append((str(r.doc_id), len(own), hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest()))
    got = fingerprints.fingerprint(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    dealt, heads = fingerprints.with_next(docs, "doc_id", "text")
    assert heads > 16 and dealt.filter("not extra").groupBy("bucket").count().agg(F.max("count")).first()[0] < 200


def test_token_files_by_range(spark, tmp_path):
    """Files of any size are read in ranges: documents that many blocks hold, an odd end, an empty file, names with spaces."""
    rnd = random.Random(3)
    want = []
    for name, n in (("a b.bin", 5000), ("c%20d.bin", 17), ("none.bin", 0)):
        ids = [END if rnd.random() < 0.01 else rnd.randrange(END) for _ in range(n)]
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        start = k = 0
        for i, x in enumerate([*ids, None]):
            if x == END or x is None and i > start:
                want.append((name, k, start, i - start))
                start, k = i + 1, k + 1
    for block, span in ((64, 3), (2, 1000), (1 << 17, 512)):
        blocks = token_counts.read_token_files(spark, str(tmp_path), block, span)
        assert sorted((r.shard.rsplit("/", 1)[-1], r.ordinal, r.start, r.n_tokens) for r in token_counts.token_counts(blocks).collect()) == sorted(want)
