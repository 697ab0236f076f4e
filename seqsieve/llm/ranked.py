"""Ranked lexical search: documents in FP-trees of the items' terms, searched by branch and bound for each item."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, documents, pieces, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Terms (with repeats) of the items that are searched for at a time: what is broadcast is a few MB, whatever the tables hold.
BLOCK_TERMS = 200_000
#: Entries (documents by their distinct terms) of one tree.
TREE_ENTRIES = 1 << 20
#: Subtrees of so few documents aren't branched any further: their documents are scored by falling bound.
LEAF = 1024
_ASCII = str.maketrans(UPPER, LOWER)


def terms_of(text: str | None) -> list[str]:
    return regex.findall(TERM, (text or "").translate(_ASCII))


def term_counts(docs: DataFrame, known, doc: str, text: str) -> DataFrame:
    """(doc, n, terms, tfs) of each document with a term, stored: all its terms' number, and of the terms in `known` (a broadcast
    dict of numbers) the numbers and how often they occur."""

    def run(batches):
        number = known.value
        for batch in pieces(batches, "text"):
            rows, sizes, terms, tfs, offsets = [], [], [], [], [0]
            for i, x in enumerate(batch.column("text").to_pylist()):
                words = terms_of(x)
                if not words:
                    continue
                rows.append(i)
                sizes.append(len(words))
                own = Counter(map(number.get, words))
                own.pop(None, None)
                terms += own.keys()
                tfs += own.values()
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    picked = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = T.StructType([picked.schema["doc"], *T.StructType.fromDDL("n long, terms array<int>, tfs array<long>")])
    return stored(picked.mapInArrow(run, kind), "terms")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def worth(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score: grows with tf, falls with m, so that a greatest tf and a least m bound it."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Tree:
    """An FP-tree of documents. Each document's terms stand by falling frequency (the lower number first); documents are sorted
    by these rows, so that a node, a shared beginning of rows, is a range of documents, and its subtree all nodes in the range.

    Of each node the range, the depth, the greatest tf of its term and the least m in the range are kept, in lists by term."""

    def __init__(self, docs: list, m: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray]):
        # terms are numbered by falling frequency: a row in order is a sorted row
        rows = []
        for t, f in zip(terms, tfs, strict=True):
            by = np.argsort(t, kind="stable")
            rows.append((t[by], f[by]))
        keys = [r[0].astype(">u4").tobytes() for r in rows]
        order = sorted(range(len(docs)), key=keys.__getitem__)
        self.docs, self.m = [docs[i] for i in order], m[order]
        sizes = np.array([len(rows[i][0]) for i in order])
        self.ptr = np.concatenate(([0], np.cumsum(sizes)))
        self.terms, self.tfs = np.concatenate([rows[i][0] for i in order]), np.concatenate([rows[i][1] for i in order])
        # how long a beginning each row shares with the one before
        shared, last = np.zeros(len(order), np.int64), None
        for at, i in enumerate(order):
            t = rows[i][0]
            if last is not None:
                k = min(len(t), len(last))
                differ = np.flatnonzero(t[:k] != last[:k])
                shared[at] = differ[0] if len(differ) else k
            last = t
        # a row opens a node at each depth it doesn't share; the node lasts until a row shares less than that depth
        depth = np.arange(len(self.terms)) - np.repeat(self.ptr[:-1], sizes)
        doc = np.repeat(np.arange(len(order)), sizes)
        opens = depth >= shared[doc]
        by_depth = np.lexsort((doc, depth))  # entries of one depth together, by document
        lead = opens[by_depth]
        node = np.cumsum(lead) - 1  # of each entry, its node
        starts = np.flatnonzero(lead)
        self.tf_most = np.maximum.reduceat(self.tfs[by_depth], starts)
        self.m_least = np.minimum.reduceat(self.m[doc[by_depth]], starts)
        first = by_depth[starts]
        self.start, self.depth, self.term = doc[first], depth[first], self.terms[first]
        self.end = self.start + np.bincount(node, minlength=len(starts))
        links = np.argsort(self.term, kind="stable")
        self.links, self.link_terms, self.links_most = links, self.term[links], self.term.max()

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Puts the documents that are among the best for an item's terms (sorted, with their weights by repeats) into best."""
        low, high = np.searchsorted(self.link_terms, terms), np.searchsorted(self.link_terms, terms, "right")
        terms, weights, low, high = (x[low < high] for x in (terms, weights, low, high))
        nodes = self.links[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])] if len(terms) else np.zeros(0, np.int64)
        if not len(nodes):
            return
        nodes = nodes[np.lexsort((self.depth[nodes], -self.end[nodes], self.start[nodes]))]  # depth-first order of the item's own tree
        start, end = self.start[nodes], self.end[nodes]
        adds = worth(weights[np.searchsorted(terms, self.term[nodes])], self.tf_most[nodes], self.m_least[nodes])
        # bound of each document: what all nodes that hold it add, as the ranges' gains and losses run on
        step = np.zeros(len(self.docs) + 1, np.int64)
        np.add.at(step, start, adds)
        np.add.at(step, end, -adds)
        level = np.cumsum(step)[:-1]
        after = np.searchsorted(start, end)  # a subtree's nodes are those from itself to before this one
        own = np.zeros(int(self.links_most) + 1, np.int64)
        own[terms] = weights
        stack = [(0, len(nodes), 0, len(level))]
        while stack:
            at, stop, a, b = stack.pop()
            bounds = level[a:b]
            if bounds.max() < max(best.least, 1):
                continue  # none below this node is good enough
            rest, deeper = np.ones(b - a, bool), []
            for i in (at + np.flatnonzero(end[at:stop] - start[at:stop] > LEAF)).tolist():
                if not deeper or i >= deeper[-1][2]:  # the topmost of the large ones
                    deeper.append((int(level[start[i] : end[i]].max()), i + 1, int(after[i]), int(start[i]), int(end[i])))
                    rest[start[i] - a : end[i] - a] = False
            self._score(a + np.flatnonzero(rest), level, own, best)
            stack += [d[1:] for d in sorted(deeper)]

    def _score(self, at: np.ndarray, level: np.ndarray, own: np.ndarray, best: Best) -> None:
        """Scores documents by falling bound, in runs, as long as it is good enough."""
        at = at[level[at] >= max(best.least, 1)]
        at, done, run = at[np.argsort(-level[at], kind="stable")], 0, 64
        while done < len(at) and level[at[done]] >= best.least:
            now = at[done : done + run]
            sizes = self.ptr[now + 1] - self.ptr[now]
            to = np.cumsum(sizes)
            entry = np.repeat(self.ptr[now] - to + sizes, sizes) + np.arange(to[-1])
            best.add(np.add.reduceat(worth(own[self.terms[entry]], self.tfs[entry], np.repeat(self.m[now], sizes)), to - sizes), now, self.docs)
            done, run = done + run, min(2 * run, 4096)


class Best:
    """The TOP best (score, doc) so far: falling scores, equal ones by rising doc, null last."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.least = 1

    def add(self, scores: np.ndarray, at: np.ndarray, docs: list) -> None:
        good = scores >= self.least
        new = [(-s, docs[i] is None, docs[i]) for s, i in zip(scores[good].tolist(), at[good].tolist(), strict=True)]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (r[0], r[1], 0 if r[2] is None else r[2]))[:TOP]
            if len(self.rows) == TOP:
                self.least = -self.rows[-1][0]


def _trees(batches: Iterator[pa.RecordBatch], n: int, total: int) -> Iterator[Tree]:
    docs, m, terms, tfs, have = [], [], [], [], 0
    for batch in batches:
        size = batch.column("n").to_numpy()
        for i in range(batch.num_rows):
            t = batch.column("terms")[i].values.to_numpy(zero_copy_only=False)
            if not len(t):
                continue
            docs.append(batch.column("doc")[i].as_py())
            m.append(100 - 25 + 25 * int(size[i]) * n // total)
            terms.append(t)
            tfs.append(batch.column("tfs")[i].values.to_numpy(zero_copy_only=False))
            have += len(t)
            if have >= TREE_ENTRIES:
                yield Tree(docs, np.array(m, np.int64), terms, tfs)
                docs, m, terms, tfs, have = [], [], [], [], 0
    if docs:
        yield Tree(docs, np.array(m, np.int64), terms, tfs)


def item_blocks(items: DataFrame, item: str, text: str, most: int = BLOCK_TERMS) -> Iterator[dict]:
    """The items as dicts (item: counts of its terms), in blocks of about `most` terms, streamed through the driver one after
    the other, so that a block is all that is held and broadcast. Equal rows (item, text) count once."""
    block, size = [], 0
    for row in items.select(F.col(item).alias("item"), F.col(text).alias("text")).distinct().toLocalIterator():
        own = Counter(terms_of(row.text))
        block.append((row.item, own))
        size += len(own) + 1
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, doc, score): the `top` (TOP at most) best documents of each item with a score above 0, equal scores by
    rising doc, null last, equal docs in any order (their rows are the same).

    Null and empty texts have no terms: such documents are in no count and no result, such items have no rows. Repeated
    documents count and stand in the result as often as they are there; equal rows of items count once, and rows of one item
    with different texts are ranked by themselves. Other columns are not looked at.

    Items are searched for in blocks. For a block all documents' texts are read for the terms that its items have; statistics
    are over all documents. Each task puts its documents into trees of bounded size and keeps the best of each item, which also
    bound the search in its later trees; the best of all tasks are ranked in two steps."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, item, text):
        vocabulary = sorted({t for _, own in block for t in own})
        if vocabulary:
            found = _best_of_block(spark, docs, block, vocabulary, doc, text, top, items.schema[item].dataType)
            out = found if out is None else out.union(found)
    if out is None:
        kinds = [T.StructField(item, items.schema[item].dataType), T.StructField("rank", T.IntegerType()), T.StructField(doc, docs.schema[doc].dataType), T.StructField("score", T.LongType())]
        return spark.createDataFrame([], T.StructType(kinds))
    return out.withColumnsRenamed({"item": item, "doc": doc})


def _best_of_block(spark: SparkSession, docs: DataFrame, block: list, vocabulary: list[str], doc: str, text: str, top: int, item_type: T.DataType) -> DataFrame:
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    counts = term_counts(docs, known, doc, text)
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.term: r.df for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # the block's terms at most
    # numbers by falling frequency: the trees' order
    order = sorted(range(len(vocabulary)), key=lambda i: (-df.get(i, 0), i))
    number = np.zeros(len(vocabulary), np.int32)
    number[order] = np.arange(len(order))
    weights = {int(number[i]): weight(n, df.get(i, 0)) for i in range(len(vocabulary))}
    place = {t: int(number[i]) for i, t in enumerate(vocabulary)}
    queries = []
    for nth, (name, own) in enumerate(block):
        terms = sorted((place[t], k) for t, k in own.items() if df.get(known.value[t], 0))
        queries.append((nth, name, np.array([t for t, _ in terms], np.int64), np.array([weights[t] * k for t, k in terms], np.int64)))
    shared = spark.sparkContext.broadcast((number, queries))
    item_kind = pa.array([q[1] for q in queries]).type if any(q[1] is not None for q in queries) else pa.int64()

    def run(batches):
        number, queries = shared.value
        best = [Best() for _ in queries]
        doc_type = None

        def renumbered():
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field("doc").type
                t = batch.column("terms")
                flat = pa.array(number[t.values.to_numpy(zero_copy_only=False)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), pa.ListArray.from_arrays(t.offsets, flat), batch.column("tfs")], names=["doc", "n", "terms", "tfs"])

        for tree in _trees(renumbered(), n, total):
            for (_, _, terms, weights), b in zip(queries, best, strict=True):
                tree.search(terms, weights, b)
        rows = [(nth, name, r[2], -r[0]) for (nth, name, _, _), b in zip(queries, best, strict=True) for r in b.rows]
        if rows:
            nth, names, found, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int32()), pa.array(names, item_kind), pa.array(found, doc_type), pa.array(scores, pa.int64())], names=["nth", "item", "doc", "score"])

    kind = T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("item", item_type), T.StructField("doc", counts.schema["doc"].dataType), T.StructField("score", T.LongType())])
    found = counts.select("doc", "n", "terms", "tfs").mapInArrow(run, kind)
    by = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    for keys in (["nth", F.pmod(F.hash("doc", "score"), F.lit(64))], ["nth"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= min(top, TOP))
    return found.select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, w AS found, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS total FROM docs),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(found) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
items AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weighted AS (SELECT item_id, term, k * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM items JOIN dfs USING (term), whole),
scored AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // total)))) AS BIGINT) AS score
FROM weighted JOIN tfs USING (term) JOIN docs USING (r), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
