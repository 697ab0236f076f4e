"""Suffix-array dedup of byte strings that occur more than once: bucket-pointer refinement, to the depths that count.

Suffixes are told apart to a depth of `lengths` bytes only (200, then 400), and buckets of one are dropped at each level:
1. q-gram buckets (q = 64): of each 200-byte string the q-gram with the least identifier is sampled. A table of the samples
   is grouped by identifier; strings whose sample is alone in its bucket can't be repeated;
2. a sample whose whole surroundings (all strings around it) are in a bucket of two or more settles these;
3. the strings around the other samples are refined bucket by bucket: sorted by their identifiers to depth 200, which are
   made from those of their q-grams and of those at later offsets; new buckets are runs of equal ones;
4. the next depth reuses these updates: only strings whose 200 bytes and whose 200 bytes at the later offset are both in
   buckets of two or more are sorted, by the pair of identifiers at both offsets.
Two strings are one if they have the same q-gram bucket and the same identifier of the level, 128 bits in all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, pieces, set_aside, settled, stored

#: Occurrences of a sample beyond which its strings are compared by the aggregate.
HOT = 10_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


_TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))


def _joined(first: np.ndarray, second: np.ndarray, offset: int, size: int) -> np.ndarray:
    """Identifiers of longer grams: first at a position, and second (of `size` bytes) at the offset after it."""
    n = max(0, len(second) - offset)
    return first[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + second[offset : offset + n]


def gram_ids(data: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of the q-grams at each position; q is a multiple of 25 times a power of 2, or any smaller number.

    The bytes' identifiers are joined to those of 2, 4, 8, 16 bytes, these to q / 2 ** k, and so on by doubling."""
    start = q
    while start % 2 == 0 and start > 32:
        start //= 2
    powers, k = [_TABLE[data]], 1
    while 2 * k <= start:
        powers.append(_joined(powers[-1], powers[-1], k, k))
        k *= 2
    ids, size = powers[-1], k
    for i in range(len(powers) - 2, -1, -1):
        if size + (1 << i) <= start:
            ids, size = _joined(ids, powers[i], size, 1 << i), size + (1 << i)
    while size < q:
        ids, size = _joined(ids, ids, size, size), 2 * size
    return ids


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width] at each i."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:]) if len(x) > k else x[:0]
        k *= 2
    if k < width:
        x = pick(x[: len(x) - (width - k)], x[width - k :]) if len(x) > width - k else x[:0]
    return x


def refined_ids(ids: np.ndarray, depth: int, wanted: int) -> np.ndarray:
    """Identifiers to the depth `wanted` from those to a smaller one: each step pairs a position's with a later offset's."""
    while depth < wanted:
        step = min(2 * depth, wanted)
        n = max(0, len(ids) - (step - depth))
        ids = _mixed(ids[:n]) * np.uint64(_BASE) + ids[step - depth : step - depth + n]
        depth = step
    return ids


def first_gram(length: int) -> int:
    """Bytes of the initial q-grams: 64 for 200."""
    return max(1, 8 * length // 25)


def samples(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed identifiers of the q-grams at each position; the least of them in the string at each position (only where a string
    of a document starts; else 0); the positions sampled; and the document of each."""
    q = first_gram(length)
    ids = _mixed(gram_ids(data, q))
    least = _sliding(ids, length - q + 1, np.minimum)
    sizes = np.diff(offsets)
    edges = np.zeros(len(data) + 1, np.int32)
    long = sizes >= length
    np.add.at(edges, offsets[:-1][long], 1)
    np.add.at(edges, offsets[1:][long] - length + 1, -1)
    starts = np.cumsum(edges[:-1], dtype=np.int32) > 0
    least = np.where(starts[: len(least)], least, np.uint64(0))
    none = np.zeros(length - q, np.uint64)
    reach = _sliding(np.concatenate((none, least, none)), length - q + 1, np.maximum)  # over the starts whose string has the gram
    n = min(len(reach), len(ids))
    at = np.flatnonzero((reach[:n] == ids[:n]) & (reach[:n] > 0))
    return ids, least, at, np.searchsorted(offsets, at, "right") - 1


def sampled(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Rows (key, pos, h, span) of the samples of each row (key, text): h the bucket identifier of the q-gram, span that of all
    bytes that strings around it have, with where they end."""
    short, long = lengths[0], lengths[-1]
    back = short - first_gram(short)

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            data, offsets = flat(batch.column("text"))
            ids, _, at, doc = samples(data, offsets, short)
            pos, size, raw = at - offsets[doc], np.diff(offsets)[doc], data.tobytes()
            left, right = np.minimum(pos, back), np.minimum(size - pos, long)
            digest = xxhash.xxh3_64_intdigest
            span = [digest(raw[a - x : a + y], x << 32 | y) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(ids[at].view(np.int64)), pa.array(np.array(span, np.uint64).view(np.int64))], names=["key", "pos", "h", "span"])

    return texts.select("key", "text").mapInArrow(run, "key binary, pos int, h long, span long")


def _own_strings(size: int, pos: int, lengths: tuple[int, ...], level: int) -> tuple[int, int]:
    """First and last start of the strings of the level's length whose first lengths[0] bytes hold the whole sample at pos."""
    return max(0, pos - (lengths[0] - first_gram(lengths[0]))), min(pos, size - lengths[level])


def _marked(again: list | None, starts: list[int] | None) -> np.ndarray:
    """The starts marked by refinement: bits of runs, and single ones."""
    bits = [r["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["again"], np.uint8))) for r in again or []]
    return np.concatenate([np.array(starts or [], np.int64), *bits]).astype(np.int64)


def repeated_starts(size: int, settled: list[int], again: list | None, starts: list[int] | None, lengths: tuple[int, ...], level: int) -> np.ndarray:
    """For each start of a string of the level's length, whether the string is repeated."""
    n = max(0, size - lengths[level] + 1)
    edge = np.zeros(n + 1, np.int32)
    for pos in settled:
        a, b = _own_strings(size, pos, lengths, level)
        if a <= b:
            edge[a] += 1
            edge[b + 1] -= 1
    found = np.cumsum(edge[:-1]) > 0
    found[_marked(again, starts)] = True
    return found


def _own_runs(batch: pa.RecordBatch, column: str, lengths: tuple[int, ...], level: int):
    """For each row and each open sample of the column: the row's place in the batch and in the data, the sample's identifier,
    and the starts of the strings whose sample it is and which are open at the level. Also the identifiers of the level."""
    short, more = lengths[0], lengths[level] - lengths[level - 1]
    data, offsets = flat(batch.column("text"))
    ids, least, _, _ = samples(data, offsets, short)
    full = refined_ids(gram_ids(data, first_gram(short)), first_gram(short), lengths[level])

    def runs():
        sizes, columns = np.diff(offsets).tolist(), [batch.column(c).to_pylist() for c in (column, "settled", *(["again", "starts"] if level else []))]
        for i, (o, size, wanted, settled, *before) in enumerate(zip(offsets[:-1].tolist(), sizes, *columns, strict=True)):
            if not wanted:
                continue
            if level:
                known = repeated_starts(size, settled, *before, lengths, level - 1)
                known = known[: len(known) - more] & known[more:] if len(known) > more else known[:0]
            last: dict[int, int] = {}
            for pos in sorted(wanted):
                a, b = _own_strings(size, pos, lengths, level)
                h = ids[o + pos]
                a = max(a, last.get(int(h), -1) + 1)  # of equal samples in a string the first counts
                last[int(h)] = pos
                if a <= b:
                    own = least[o + a : o + b + 1] == h
                    yield i, o, h, np.flatnonzero(own & known[a : b + 1] if level else own) + a

    return full, runs()


def open_runs(candidates: DataFrame, lengths: tuple[int, ...], level: int) -> DataFrame:
    """Rows (h, key, cid, start, ids): for each open sample the identifiers (8 bytes each) of the strings that are its own, a
    row for each unbroken run of them."""

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            full, runs = _own_runs(batch, "open", lengths, level)
            which, out = [], []
            for i, o, h, starts in runs:
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
                    which.append(i)
                    out.append((int(h.view(np.int64)), int(part[0]), full[o + part].tobytes()))
            if out:
                h, start, ids = (pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True))
                own = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([h, batch.column("rank").take(own), batch.column("cid").take(own), start, ids], names=["h", "rank", "cid", "start", "ids"])

    return candidates.filter(F.size("open") > 0).mapInArrow(run, "h long, rank long, cid long, start int, ids binary")


def repeated_runs(runs: DataFrame, keep_first: bool) -> DataFrame:
    """Rows (cid, start, again): which strings of each run occur more than once among those of the same h, as a bit each; with
    keep_first, which occur before (in a text of a lesser rank, or earlier in the same).

    Runs are dealt and sorted by h; a task goes through its buckets and refines one at a time, or a few small ones."""

    def find(rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("ids").combine_chunks()
        sizes = pa.compute.binary_length(raw).to_numpy() // 8
        ids = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        h = rows.column("h").to_numpy()
        bucket = np.repeat(np.cumsum(np.concatenate(([False], h[1:] != h[:-1]))), sizes)
        ends = np.cumsum(sizes)
        if keep_first:
            start = np.arange(len(ids)) - np.repeat(ends - sizes - rows.column("start").to_numpy(), sizes)
            by = np.lexsort((start, np.repeat(rows.column("cid").to_numpy(), sizes), np.repeat(rows.column("rank").to_numpy(), sizes), ids, bucket))
        else:
            by = np.lexsort((ids, bucket))
        as_before = np.concatenate(([False], (ids[by[1:]] == ids[by[:-1]]) & (bucket[by[1:]] == bucket[by[:-1]])))
        again = np.empty(len(ids), bool)
        again[by] = as_before if keep_first else as_before | np.append(as_before[1:], False)
        any_ = np.add.reduceat(again, ends - sizes) > 0
        bits = [np.packbits(again[e - k : e]).tobytes() for e, k, x in zip(ends.tolist(), sizes.tolist(), any_.tolist(), strict=True) if x]
        kept = rows.filter(pa.array(any_))
        one = lambda c: kept.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays([one("cid"), one("start"), pa.array(bits, pa.binary())], names=["cid", "start", "again"])

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches, "ids", 4 << 20):
            held.append(batch)
            size += batch.nbytes
            if size < 4 << 20:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            if cut:
                yield find(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield find(pa.Table.from_batches(held))

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "cid long, start int, again binary")


def open_strings(candidates: DataFrame, lengths: tuple[int, ...], level: int) -> DataFrame:
    """Rows (h, id, rank, cid, start) of the strings whose sample is among the row's hot ones."""

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            full, runs = _own_runs(batch, "hot", lengths, level)
            for i, o, h, s in runs:
                same = lambda c: pa.array(np.full(len(s), batch.column(c)[i].as_py()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), h).view(np.int64)), pa.array(full[s + o].view(np.int64)), same("rank"), same("cid"), pa.array(s.astype(np.int32))], names=["h", "id", "rank", "cid", "start"])

    return candidates.filter(F.size("hot") > 0).mapInArrow(run, "h long, id long, rank long, cid long, start int")


def refine(candidates: DataFrame, lengths: tuple[int, ...], level: int, keep_first: bool, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """The marks of a level: (cid, again), the bits of runs, and (cid, starts), those of hot buckets, which are compared by an
    aggregate over strings, joined again in `salts` parts each: never by a broadcast, as its size is told without the parts."""
    runs = repeated_runs(open_runs(candidates, lengths, level), keep_first)
    marked = runs.groupBy("cid").agg(F.collect_list(F.struct("start", "again")).alias("again"))
    strings = stored(open_strings(candidates, lengths, level), "strings").withColumn("salt", F.pmod("cid", F.lit(salts)))
    twice = strings.groupBy("h", "id").agg(F.count("*").alias("n"), F.min(F.struct("rank", "cid", "start")).alias("first")).filter("n > 1")
    twice = stored(twice, "twice").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    again = strings.join(twice.hint("merge"), ["h", "id", "salt"])
    if keep_first:
        again = again.filter(F.struct("rank", "cid", "start") != F.col("first"))
    return marked, again.groupBy("cid").agg(F.collect_list("start").alias("starts"))


def covered(size: int, repeated: np.ndarray, length: int) -> np.ndarray:
    """Whether each byte is in a string of the length that starts where `repeated` says so."""
    edge = np.zeros(size + 1, np.int32)
    edge[: len(repeated)] += repeated
    edge[length : length + len(repeated)] -= repeated
    return np.cumsum(edge[:-1]) > 0


RESULT = "key binary, n_removed long, n_spans long, n_shared long, kept binary, left string"


def repeats(texts: DataFrame, lengths: tuple[int, ...] = (200, 400), hot: int = HOT, keep_first: bool = False) -> DataFrame:
    """For each distinct text that has something repeated: key (its MD5, 16 bytes), n_removed, n_spans, n_shared, kept (the
    bytes left) and left (these as a text, without letters that are cut in two).

    texts: rows (key, text) with repeats, each of which counts as an occurrence. Every byte goes that lies in a string of
    lengths[-1] bytes that starts anywhere else too, in another row or in the same; n_shared counts those in such strings of
    lengths[0] bytes. With keep_first (and one length) only those that start earlier too, in the same text or in one of a lesser
    key, so that one occurrence stays; copies of a text are then no occurrences of their own. Copies are worked on once.
    Strings around samples of buckets of up to `hot` are compared bucket by bucket; those of larger buckets by an aggregate
    over all strings, by the same identifiers, so that no bucket must fit a task.
    """
    if keep_first and len(lengths) > 1:
        raise ValueError("keep_first takes one length")
    rows = stored(sampled(texts, lengths), "samples")
    # this and `mixed` are stored, so that the joins with them are fed by plain shuffles, which Spark can split where one is hot
    buckets = stored(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).filter("n > 1"), "repeated")
    kept = stored(rows.join(buckets.select("h", (F.col("low") == F.col("high")).alias("alike"), (F.col("n") > hot).alias("large")), "h"), "buckets")
    own = F.struct("key", "pos")
    mixed = stored(kept.filter(F.lit(keep_first) | ~F.col("alike")).groupBy("h", "span").agg(F.count("*").alias("n"), F.min(own).alias("one")).filter("n > 1").select("h", "span", "one"), "mixed")
    # of the alike surroundings in a bucket that also holds others, one lends its strings to the comparison
    joined = (kept if keep_first else kept.filter("not alike")).join(mixed, ["h", "span"], "left")
    first = F.col("one").isNull() | (own == F.col("one"))
    settled = ~first if keep_first else F.col("one").isNotNull()
    marks = joined.select("key", "pos", "large", settled.alias("settled"), (first & ~F.col("alike")).alias("open"))
    if not keep_first:
        marks = kept.filter("alike").select("key", "pos", "large", F.lit(True).alias("settled"), F.lit(False).alias("open")).union(marks)
    marks = marks.groupBy("key").agg(F.collect_set(F.when(F.col("settled"), F.col("pos"))).alias("settled"), *(F.collect_set(F.when(F.col("open") & large, F.col("pos"))).alias(c) for c, large in (("open", ~F.col("large")), ("hot", F.col("large")))))
    distinct = texts.groupBy("key").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    rank = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")
    # numbers that the stored table keeps
    found = stored(distinct.join(marks, "key").withColumn("cid", F.monotonically_increasing_id()).withColumn("rank", rank), "candidates")
    for level in range(len(lengths)):
        marked, starts = refine(found, lengths, level, keep_first)
        found = found.drop("again", "starts").join(marked, "cid", "left").join(starts, "cid", "left")
        if level == 0:  # a text without a repeat at the first depth has none at the next
            found = found.filter("size(settled) > 0 or again is not null or starts is not null").withColumn("again0", F.col("again")).withColumn("starts0", F.col("starts"))
        if level < len(lengths) - 1:
            found = stored(found, "refined")

    def cut(batches):
        for batch in pieces(batches, "text", 1 << 20):
            out = []
            for key, text, settled, *marks in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "settled", "again", "starts", "again0", "starts0")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                gone, shared = (covered(len(data), repeated_starts(len(data), settled, *m, lengths, level), lengths[level]) for m, level in ((marks[:2], len(lengths) - 1), (marks[2:], 0)))
                if shared.any():
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = data[~gone].tobytes()
                    out.append((key, int(gone.sum()), spans, int(shared.sum()), kept, kept.decode(errors="ignore")))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "n_removed", "n_spans", "n_shared", "kept", "left"])

    return found.select("key", "text", "settled", "again", "starts", "again0", "starts0").mapInArrow(cut, RESULT)


def text_key(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, hot: int = HOT, keep_first: bool = False) -> DataFrame:
    """All columns of docs, then n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; the text is what is left
    of it (a letter that is cut in two goes). A null text counts as empty and stays null; other columns don't matter, but
    those of the names added are replaced. Repeated rows are each other's copies, so long ones lose all; with keep_first, of
    each repeated string one occurrence stays, and repeated rows stay alike. Memory: a text and its arrays at a time."""
    docs, back = set_aside(docs, ("_key", "_removed", "_spans", "_sha", "_left"))
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    keyed = docs.select(*own, text_key(F.col(text)).alias("_key"))
    texts = keyed.select(F.col("_key").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    found = settled(docs.sparkSession, "repeats", lambda: repeats(texts, (length,), hot, keep_first).select("key", "n_removed", "n_spans", "kept", "left"))
    found = found.select(F.col("key").alias("_key"), F.col("n_removed").alias("_removed"), F.col("n_spans").alias("_spans"), F.sha2("kept", 256).alias("_sha"), F.col("left").alias("_left"))
    raw = F.coalesce(text, F.lit("")).cast("binary")
    left = keyed.join(found, "_key", "left")
    shown = F.coalesce("_left", F.col(text))
    more = {"n_bytes": F.length(raw).cast("long"), "n_removed": F.coalesce("_removed", F.lit(0)).cast("long"), "n_spans": F.coalesce("_spans", F.lit(0)).cast("long"), "kept_sha256": F.coalesce("_sha", F.sha2(raw, 256))}
    return left.select(*(c for c in own if c != text), shown.alias(text), *(v.alias(k) for k, v in more.items())).select(*own, *more).withColumnsRenamed(back)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stay where they are: only keys, sizes and digests are joined to what was found. n_shared, after the contract's
    columns, counts the bytes in repeated strings of 200 bytes, the depth before."""
    docs = documents(spark, sf_dir)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    texts = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = settled(spark, "repeats", lambda: repeats(texts).select("key", "n_removed", "n_spans", "n_shared", F.sha2("kept", 256).alias("kept_sha256")))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, "key", "left").select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), count("n_shared"))
