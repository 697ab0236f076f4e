"""LM scoring by prediction by partial matching: a byte-context trie, learned once, gives each document's code length.

A text is read as its words (A-Z lower-cased), each ended by a space, then an end. The context of a byte is the ORDER bytes
before it, whatever words they are in; before a text there are ends. Escapes are estimated as in method C (as many as symbols
seen in the context), and symbols seen in the longer contexts are excluded from the shorter ones.

The trie is counted from all windows (a context and its byte) of the texts, each distinct window is scored once, and
documents add up the scores of theirs. The windows are tables, grouped by the last two bytes of their contexts; the most
frequent ones are at hand in each task, the others are joined. score_documents() is the model whose contexts stop at the space
before the word, where all occurrences of a word have one probability; the query doesn't use it.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold, pieces, stored

#: Bytes of the longest context, at most 7.
ORDER = 5
#: At most so many of the most frequent words are at hand in every task; the others are joined.
HEAD = 1 << 17
#: At most so many of the most frequent windows (a context and its byte) are at hand in every task; the others are joined.
WINDOWS = 1 << 20
#: Words of a block, about.
BLOCK = 400_000
SPACE, END = 0x20, b"\n"


def count_words(docs: DataFrame, text: str, train: str) -> DataFrame:
    """Rows (word: binary, c): its count where the column train is true, 0 if it is elsewhere only; the end has the word "\\n"."""

    def run(batches):
        for batch in pieces(batches, text, 32 << 20):
            learned, others = Counter(), set()
            for x, use in zip(batch.column(text).to_pylist(), batch.column(train).to_pylist(), strict=True):
                words = (x or "").encode().lower().split()
                words.append(END)
                if use:
                    learned.update(words)
                else:
                    others.update(words)
            others = [w for w in others if w not in learned]
            yield pa.RecordBatch.from_arrays([pa.array([*learned, *others], pa.binary()), pa.array([*learned.values(), *[0] * len(others)], pa.int64())], names=["word", "c"])

    return docs.select(text, train).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_windows(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words as they are spelled: its context and itself in one number, and the word it is in."""
    parts, sizes = [], np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        p = b" \n" if w == END else b" " + w + b" "
        parts.append(p)
        sizes[i] = len(p)
    data = np.frombuffer(b"".join(parts), np.uint8)
    word = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = data.astype(np.uint64)
    for j in range(1, order + 1):
        code[j:] |= np.where(depth[j:] >= j, data[:-j], 0).astype(np.uint64) << np.uint64(8 * j)
    own = depth > 0
    return code[own], word[own]


def context_sizes(code: np.ndarray, order: int) -> np.ndarray:
    """Bytes of each window's context: up to the space before the word, `order` if that is further off."""
    size = np.full(len(code), order, np.int64)
    for j in range(order, 0, -1):
        size[(code >> np.uint64(8 * j) & np.uint64(255)) == SPACE] = j
    return size


def text_windows(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of texts given as words: its context and itself in one number, and the text it is in. Contexts reach
    over words; before a text there are ends."""
    parts = [END * order + b" ".join([*words[:-1], END]) for words in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    code = data.astype(np.uint64)
    for j in range(1, order + 1):
        code[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    text = np.repeat(np.arange(len(parts)), sizes)
    own = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order
    return code[own], text[own]


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def window_scores(code: np.ndarray, c: np.ndarray, pairs: np.ndarray, order: int = ORDER, across: bool = False) -> np.ndarray:
    """log10 of the probability of each window's byte. code: distinct windows, with all those that share the last two bytes
    of a context together; c: their counts; pairs: 256 x 256 counts of each byte after each other byte, over all windows; across:
    contexts reach over words."""
    n, size = len(code), np.full(len(code), order) if across else context_sizes(code, order)
    single = pairs.sum(axis=0)
    # counts of the symbol, of the context, and of the context's distinct symbols, by order; and what the symbols seen in the
    # context that is one longer count there
    c_k, t_k, d_k, gone_t, gone_d = (np.zeros((order + 2, n)) for _ in range(5))
    last, sym = (code >> np.uint64(8) & np.uint64(255)).astype(np.int64), (code & np.uint64(255)).astype(np.int64)
    c_k[0], t_k[0], d_k[0] = single[sym], single.sum(), np.count_nonzero(single)
    seen = pairs > 0
    c_k[1], t_k[1], d_k[1] = pairs[last, sym], pairs.sum(axis=1)[last], seen.sum(axis=1)[last]
    gone_t[0], gone_d[0] = (seen * single).sum(axis=1)[last], d_k[1]
    for k in range(2, order + 1):
        own = np.flatnonzero(size >= k)
        if not len(own):
            break
        pair, first, which = np.unique(code[own] & _mask(k + 1), return_index=True, return_inverse=True)
        count = np.bincount(which, c[own], len(pair))
        ctx, of = np.unique(pair >> np.uint64(8), return_inverse=True)
        known = count > 0
        c_k[k, own], t_k[k, own], d_k[k, own] = count[which], np.bincount(of, count)[of][which], np.bincount(of, known)[of][which]
        shorter = np.where(known, c_k[k - 1, own[first]], 0)
        gone_t[k - 1, own], gone_d[k - 1, own] = np.bincount(of, shorter)[of][which], d_k[k, own]
    score, done = np.zeros(n), np.zeros(n, bool)
    for k in range(order, -1, -1):
        t, d = t_k[k] - gone_t[k], d_k[k] - gone_d[k]
        use = ~done & (size >= k) & (d > 0)
        hit = use & (c_k[k] > 0)
        up = np.where(hit, c_k[k], d)
        score[use] += np.log10(up[use] / (t + d)[use])
        done |= hit
    unseen = 256 - np.count_nonzero(single)
    if unseen:
        score[~done] -= log10(unseen)
    return score


def score_words(vocabulary: DataFrame, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """Adds score to a stored vocabulary (word, c): log10 of the probability that the trie gives the word's bytes and its space."""
    blocks = max(1, -(-vocabulary.count() // block))
    words = vocabulary.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))

    def windows(table: pa.Table) -> pa.Table:
        code, word = word_windows(table.column("word").to_pylist(), order)
        code, which = np.unique(code, return_inverse=True)
        c = np.bincount(which, table.column("c").to_numpy()[word], len(code)).astype(np.int64)
        return pa.table({"block": np.full(len(code), table.column("block")[0].as_py(), np.int32), "code": code.view(np.int64), "c": c})

    asked = stored(words.groupBy("block").applyInArrow(windows, "block int, code long, c long"), "windows")
    nodes = stored(asked.groupBy("code").agg(F.sum("c").alias("c")), "nodes")
    last = F.shiftrightunsigned("code", 8).bitwiseAND(255)
    pairs = np.zeros((256, 256))
    for a, b, c in nodes.groupBy(last, F.col("code").bitwiseAND(255)).agg(F.sum("c")).collect():  # 65,536 rows at most
        pairs[a, b] = c

    def scores(table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy()
        return pa.table({"code": code, "score": window_scores(code.view(np.uint64), table.column("c").to_numpy(), pairs, order)})

    group = nodes.groupBy(F.shiftrightunsigned("code", 8).bitwiseAND(65535))
    known = group.applyInArrow(scores, "code long, score double")
    told = asked.select("block", "code").join(known, "code")

    def add(own: pa.Table, answers: pa.Table) -> pa.Table:
        code, word = word_windows(own.column("word").to_pylist(), order)
        have = answers.column("code").to_numpy().view(np.uint64)
        by = np.argsort(have)
        each = answers.column("score").to_numpy()[by][np.searchsorted(have[by], code)]
        return pa.table({"word": own.column("word"), "c": own.column("c"), "score": np.bincount(word, each, len(own))})

    return words.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add, "word binary, c long, score double")


def _least_count(vocabulary: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach, of a scale with eight steps to each doubling."""
    step = F.floor(F.log2(F.col("c") + 1.0) * 8)
    left, least = most, 1 << 62
    for row in sorted(vocabulary.filter("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.step):  # 512 rows at most
        left -= row.n
        if left < 0:
            break
        least = row.c
    return least


def score_documents(docs: DataFrame, text: str, train: str, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """All columns of docs but the text, then n_tokens, n_known, train_tokens, base_score and score, learned from the rows
    where the boolean column train is true (null: false). Null texts count as empty: one token, the end. Repeated rows stay
    repeated. If nothing is learned from, base_score is null and score that of equally probable bytes.

    Of the most frequent words at most `head` are at hand in each task; occurrences of all others are joined to the vocabulary. Columns
    of the added names are replaced."""
    spark, added = docs.sparkSession, ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (text, *added)]
    learned = docs.select(text, F.coalesce(train, F.lit(False)).alias(train))
    vocabulary = stored(score_words(stored(count_words(learned, text, train), "words"), order), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    below = log10(total + 0.5 * (distinct + 1))
    top = vocabulary.filter(F.col("c") >= _least_count(vocabulary, head)).toArrow()
    c = top.column("c").to_numpy()
    numbers = np.stack((np.log10(c + 0.5) - below, top.column("score").to_numpy(), c > 0), axis=1)
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(top.column("word").to_pylist())}, numbers))

    def run(batches):
        places, numbers = shared.value
        row = TaskContext.get().partitionId() << 33
        get = places.get
        for batch in pieces(batches, text):
            sums, rare, whose, sizes = [], [], [], []
            for x in batch.column(text).to_pylist():
                words = (x or "").encode().lower().split()
                words.append(END)
                at = np.array([get(w, -1) for w in words])
                sums.append(numbers[at[at >= 0]].sum(axis=0))
                far = np.flatnonzero(at < 0).tolist()
                rare += [words[i] for i in far]
                whose += [row] * len(far)
                sizes.append(len(words))
                row += 1
            n, m = len(sizes), len(rare)
            own, s = [batch.column(c) for c in keep], np.array(sums).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*own, pa.array(range(row - n, row), pa.int64()), pa.nulls(n, pa.binary()), pa.array(sizes, pa.int64()), pa.array(s[:, 2].astype(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1])], names=names)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, c.type) for c in own), pa.array(whose, pa.int64()), pa.array(rare, pa.binary()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    names = [*keep, "_row", "_word", "_n", "_known", "_base", "_score"]
    picked = docs.select(*keep, text)
    nullable = [T.StructField(f.name, f.dataType) for f in picked.select(*keep).schema]
    more = T.StructType.fromDDL("_row long, _word binary, _n long, _known long, _base double, _score double")
    rows = stored(picked.mapInArrow(run, T.StructType([*nullable, *more])), "tokens")
    rare = rows.filter("_word is not null").select("_row", F.col("_word").alias("word")).join(vocabulary, "word")
    rare = rare.groupBy("_row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum(F.log10(F.col("c") + 0.5) - F.lit(below)).alias("b"), F.sum("score").alias("s"))
    out = rows.filter("_word is null").join(rare, "_row", "left")
    both = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    base = both("_base", "b", 0.0) if total else F.lit(None).cast("double")
    return out.select(*keep, F.col("_n").alias("n_tokens"), both("_known", "k", 0).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), both("_score", "s", 0.0).alias("score"))


def score_windows(docs: DataFrame, text: str, train: str, order: int = ORDER) -> DataFrame:
    """Rows (code: long, c, score): the distinct windows of all texts, their counts where train is true, and log10 of the
    probability that the trie over them gives the window's byte."""

    def run(batches):
        for batch in pieces(batches, text):
            use = np.array(batch.column(train).to_pylist(), bool)
            code, of = text_windows([_words(x) for x in batch.column(text).to_pylist()], order)
            learned, c = np.unique(code[use[of]], return_counts=True)
            others = np.setdiff1d(code[~use[of]], learned)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((learned, others)).view(np.int64)), pa.array(np.concatenate((c, np.zeros(len(others), np.int64))))], names=["code", "c"])

    nodes = stored(docs.select(text, train).mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "nodes")
    last = F.shiftrightunsigned("code", 8).bitwiseAND(255)
    pairs = np.zeros((256, 256))
    for a, b, c in nodes.groupBy(last, F.col("code").bitwiseAND(255)).agg(F.sum("c")).collect():  # 65,536 rows at most
        pairs[a, b] = c

    def scores(table: pa.Table) -> pa.Table:
        code, c = table.column("code").to_numpy(), table.column("c").to_numpy()
        return pa.table({"code": code, "c": c, "score": window_scores(code.view(np.uint64), c, pairs, order, across=True)})

    group = nodes.groupBy(F.shiftrightunsigned("code", 8).bitwiseAND(65535))
    return stored(group.applyInArrow(scores, "code long, c long, score double"), "scores")


def _words(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def score_texts(docs: DataFrame, text: str, train: str, order: int = ORDER, head: int = HEAD, windows: int = WINDOWS) -> DataFrame:
    """As score_documents(), but score is that of the text's bytes in contexts that reach over words: the trie is counted
    from all windows of the texts. Of the words at most `head`, of the windows at most `windows` are at hand in each task, the
    most frequent ones; all others are joined."""
    spark, added = docs.sparkSession, ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (text, *added)]
    learned = docs.select(text, F.coalesce(train, F.lit(False)).alias(train))
    vocabulary = stored(count_words(learned, text, train), "words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    below = log10(total + 0.5 * (distinct + 1))
    known = score_windows(learned, text, train, order)
    top = vocabulary.filter(F.col("c") >= _least_count(vocabulary, head)).toArrow()
    places = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    c = top.column("c").to_numpy()
    near = known.filter(F.col("c") >= _least_count(known, windows)).select("code", "score").toArrow()
    codes = near.column("code").to_numpy().view(np.uint64)
    by = np.argsort(codes)
    shared = spark.sparkContext.broadcast((places, np.stack((np.log10(c + 0.5) - below, c > 0), axis=1), codes[by], near.column("score").to_numpy()[by]))

    def run(batches):
        places, numbers, codes, scores = shared.value
        row = TaskContext.get().partitionId() << 33
        get = places.get
        for batch in pieces(batches, text):
            texts = [_words(x) for x in batch.column(text).to_pylist()]
            n = len(texts)
            sizes = np.fromiter(map(len, texts), np.int64, n)
            whose = np.repeat(np.arange(n), sizes)
            at = np.fromiter((get(w, -1) for words in texts for w in words), np.int64, int(sizes.sum()))
            here = at >= 0
            base, have = (np.bincount(whose[here], numbers[at[here], k], n) for k in (0, 1))
            far = np.flatnonzero(~here)
            flat_words = [w for words in texts for w in words]
            rare = [flat_words[i] for i in far.tolist()]
            code, of = text_windows(texts, order)
            code, which = np.unique(code, return_inverse=True)
            place = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            found = codes[place] == code if len(codes) else np.zeros(len(code), bool)
            each = np.where(found, scores[place], 0.0) if len(codes) else np.zeros(len(code))
            score = np.bincount(of, each[which], n)
            lost = np.flatnonzero(~found[which])
            own = [batch.column(c) for c in keep]
            m, k = len(rare), len(lost)
            none = lambda size, *types: [pa.nulls(size, t) for t in types]
            yield pa.RecordBatch.from_arrays([*own, pa.array(range(row, row + n), pa.int64()), *none(n, pa.binary(), pa.int64()), pa.array(sizes), pa.array(have.astype(np.int64)), pa.array(base), pa.array(score)], names=names)
            blank = lambda size: none(size, *(x.type for x in own))
            rest = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*blank(m), pa.array(row + whose[far]), pa.array(rare, pa.binary()), *none(m, pa.int64(), *rest)], names=names)
            yield pa.RecordBatch.from_arrays([*blank(k), pa.array(row + of[lost]), *none(k, pa.binary()), pa.array(code[which[lost]].view(np.int64)), *none(k, *rest)], names=names)
            row += n

    names = [*keep, "_row", "_word", "_code", "_n", "_known", "_base", "_score"]
    picked = docs.select(*keep, text)
    nullable = [T.StructField(f.name, f.dataType) for f in picked.select(*keep).schema]
    more = T.StructType.fromDDL("_row long, _word binary, _code long, _n long, _known long, _base double, _score double")
    rows = stored(picked.mapInArrow(run, T.StructType([*nullable, *more])), "tokens")
    rare = rows.filter("_word is not null").select("_row", F.col("_word").alias("word")).join(vocabulary, "word")
    rare = rare.groupBy("_row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum(F.log10(F.col("c") + 0.5) - F.lit(below)).alias("b"))
    lost = rows.filter("_code is not null").groupBy("_row", F.col("_code").alias("code")).agg(F.count("*").alias("times"))
    lost = lost.join(known.select("code", "score"), "code").groupBy("_row").agg(F.sum(F.col("score") * F.col("times")).alias("s"))
    out = rows.filter("_n is not null").join(rare, "_row", "left").join(lost, "_row", "left")
    both = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    base = both("_base", "b", 0.0) if total else F.lit(None).cast("double")
    return out.select(*keep, F.col("_n").alias("n_tokens"), both("_known", "k", 0).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), both("_score", "s", 0.0).alias("score"))


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 1
    rows = documents(spark, sf_dir).select("doc_id", held.alias("held_out"), (~held).alias("train"), "text")
    return score_texts(rows, "text", "train").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
