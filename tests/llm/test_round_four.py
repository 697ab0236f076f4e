"""What must not grow on the driver or be left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqsieve.llm import similar, substrings
from test_similar import brute_kept


def test_salted_strings_are_never_broadcast(spark, monkeypatch):
    """The strings of hot buckets are joined in parts, which their size on disk doesn't tell; results as bucket by bucket."""
    rnd = random.Random(4)
    passages = ["".join(rnd.choices("abcdefghij ", k=500)) for _ in range(3)]
    rows = [(i, f"{rnd.random()} {passages[i % 3]} {rnd.random()}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(substrings.text_key(F.col("text")).alias("key"), "text")
    plans, refine = [], substrings.refine

    def kept(*args):
        marked, starts = refine(*args)
        assert starts.count()
        plans.append(starts._jdf.queryExecution().executedPlan().toString())
        return marked, starts

    monkeypatch.setattr(substrings, "refine", kept)
    few = {bytes(r.key): r.n_removed for r in substrings.repeats(docs, hot=1).collect()}
    monkeypatch.undo()
    many = {bytes(r.key): r.n_removed for r in substrings.repeats(docs, hot=1000).collect()}
    assert few == many and len(few) == 30 and min(few.values()) >= 500
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("known", ["none", "wrong"])
def test_no_result_hangs_on_which_shingles_are_frequent(spark, monkeypatch, known):
    """What is known of frequent shingles orders them, and so decides the work; all pairs are found with nothing known, or with
    counts made up for half of all shingles."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(2000)]
    line, texts = rnd.choices(vocabulary, k=12), {}
    for i in range(25):
        own = rnd.choices(vocabulary, k=rnd.randint(30, 200)) + line
        texts[10 * i] = " ".join(own)
        for j in range(1, 5):
            new = list(own)
            for at in rnd.sample(range(len(new)), rnd.randint(1, max(1, len(new) // 25))):
                new[at] = "x" + rnd.choice(vocabulary)
            texts[10 * i + j] = " ".join(new)
    hot = np.unique(np.concatenate([similar.shingle_set(t, similar.WIDTH)[::2] for t in texts.values()]))
    made_up = (hot, np.random.default_rng(1).integers(1, 1000, len(hot))) if known == "wrong" else (hot[:0], np.zeros(0, np.int64))
    monkeypatch.setattr(similar, "frequent", lambda *args: made_up)
    docs = spark.createDataFrame([(i, t, "xx", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_kept(texts)
    assert 25 < len(want) < 120
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(want)
