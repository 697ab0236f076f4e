"""Texts scored in contexts that reach over words, against brute force."""

import random
from collections import Counter, defaultdict
from math import log10

import pytest
from pyspark.sql import functions as F

from seqsieve.llm import ppm
from tests_helpers import words


def brute_scores(texts, train, order):
    spell = lambda t: ppm.END * order + b"".join(w + b" " for w in words(t)) + ppm.END
    trie = defaultdict(Counter)
    for t, use in zip(texts, train, strict=True):
        t = spell(t)
        for i in range(order, len(t) if use else 0):
            for k in range(order + 1):
                trie[k, t[i - k : i]][t[i]] += 1
    out = []
    for t in map(spell, texts):
        s = 0.0
        for i in range(order, len(t)):
            gone = set()
            for k in range(order, -1, -1):
                left = {a: n for a, n in trie[k, t[i - k : i]].items() if a not in gone}
                if left:
                    s += log10(left.get(t[i], len(left)) / (sum(left.values()) + len(left)))
                    if t[i] in left:
                        break
                    gone |= set(left)
            else:
                s -= log10(256 - len(trie[0, b""]))
        out.append(s)
    return out


@pytest.mark.parametrize("head, windows", [(ppm.HEAD, ppm.WINDOWS), (2, 10)])
def test_scores(spark, head, windows):
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choices("abcd\u00e9", k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    texts += [None, "", "  A b\tB  a ", texts[0], "never seen: \u4e00", "\x00 \x00\x01"]
    train = [i % 3 != 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, u if u else None) for i, (t, u) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean")
    got = ppm.score_texts(docs, "text", "train", head=head, windows=windows).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(brute_scores(texts, train, ppm.ORDER))
    old = {r.doc_id: r for r in ppm.score_documents(docs, "text", "train").collect()}
    same = lambda r: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9))
    assert [same(r) for r in got] == [same(old[r.doc_id]) for r in got]


def test_order_of_words_counts(spark, tmp_path):
    """The query on documents whose words come in a fixed order: held-out texts beat the baseline, shuffled ones don't score alike."""
    rnd = random.Random(1)
    line = "a b c d e f g h i j k l".split()
    rows = [(i, " ".join(line * 3)) for i in range(50)]
    held = [r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").filter(ppm.fold(F.col("doc_id"), 5) == 1).collect()]
    rows = [(i, " ".join(rnd.sample(line * 3, 36)) if i == held[0] else t) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in ppm.op1_ppm(spark, str(tmp_path)).collect()}
    assert all(got[i].score > got[i].base_score for i in held[1:])
    assert got[held[0]].score < got[held[1]].score - 10
