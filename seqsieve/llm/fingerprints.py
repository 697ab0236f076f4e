"""Document fingerprints by content-defined chunking with a normalised gear hash."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, shuffle_partitions

#: Bytes of a chunk: the least, the one aimed at, the most.
LEAST, NORMAL, MOST = 16, 64, 256
#: Bits that must be 0 for a cut before the normal size (harder) and after it (easier).
HARD, EASY = np.uint32(0xFF << 24), np.uint32(0xF << 28)
WINDOW = 32


def _gear() -> np.ndarray:
    """256 numbers by a mixing rule (splitmix64 of the byte)."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gear hash of the last 32 bytes at each byte of the texts, laid end to end with gaps of a window; their starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1])).astype(np.int64) if texts else np.zeros(0, np.int64)
    gap = b"\0" * WINDOW
    h = GEAR[np.frombuffer(gap.join(texts) + gap, np.uint8)]
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        h[s + n : s + n + WINDOW] = 0
    k = 1
    while k < WINDOW:
        h[k:] += h[:-k] << np.uint32(k)  # right side is made first: sums over 2k bytes
        k *= 2
    return h, starts


def chunk_ends(n: int, hard: list[int], easy: list[int]) -> list[int]:
    """Ends of the chunks of n bytes, given the sorted ends at which either mask allows a cut."""
    ends, start = [], 0
    while n - start > LEAST:
        end = min(start + MOST, n)
        i = bisect_left(hard, start + LEAST)
        if i < len(hard) and hard[i] < start + NORMAL:
            end = hard[i]
        else:
            i = bisect_left(easy, start + NORMAL)
            if i < len(easy) and easy[i] < end:
                end = easy[i]
        ends.append(min(end, n))
        start = ends[-1]
    if start < n:
        ends.append(n)
    return ends


def chunk_weights(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its chunks' digests (48 bits) with the bytes that each makes up."""
    h, starts = gear_hashes(texts)
    easy = np.flatnonzero((h & EASY) == 0)
    hard = easy[(h[easy] & HARD) == 0]
    bounds = starts, starts + np.fromiter(map(len, texts), np.int64, len(texts))
    (e0, e1), (h0, h1) = [[np.searchsorted(x, b).tolist() for b in bounds] for x in (easy, hard)]
    out = []
    for k, text in enumerate(texts):
        s, found, at = int(starts[k]) - 1, Counter(), 0
        for end in chunk_ends(len(text), (hard[h0[k] : h1[k]] - s).tolist(), (easy[e0[k] : e1[k]] - s).tolist()):
            found[xxhash.xxh3_64_intdigest(text[at:end]) >> 16] += end - at
            at = end
        out.append(found)
    return out


def printed(weights: dict[int, int]) -> str:
    return ",".join(f"{d:012x}:{n}" for d, n in sorted(weights.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes whose chunks are in b; of two empty ones 1, of one 0."""
    if not a or not b:
        return float(not a and not b)
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values())


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows (bucket, extra, key, text), sorted: buckets are ranges of the key, descending, each whole in one partition. A key (or
    null) that fills several ranges is a range by itself, cut further by the hash of the text, in whose order its rows stand. An
    extra row at a bucket's end is the first of the next bucket (after the last: of the first), so that each row is followed
    by the next document. The driver holds the ranges' bounds only, some eight a partition."""
    wanted = 4 * shuffle_partitions(docs.sparkSession)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", h)
    shares = [i / wanted for i in range(1, wanted)] or [0.5]
    cut, rows, nulls = picked.agg(F.percentile_approx("key", shares, 10 * wanted), F.count("*"), F.count_if(F.col("key").isNull())).first()
    bounds, times = np.unique(np.array(cut or [], np.int64), return_counts=True)
    alone = bounds[(times > 1) & (bounds > np.iinfo(np.int64).min)]
    parts = dict(zip(bounds.tolist(), times.tolist(), strict=True))
    bounds = np.unique(np.concatenate((bounds, alone - 1)))
    # buckets of each range, the largest keys first, those of null last; a range ends with its bound
    many = [1, *(parts[b] + 1 if b in alone else 1 for b in reversed(bounds.tolist())), 1 + wanted * nulls // max(1, rows)]
    many, first = np.array(many, np.uint64), np.concatenate(([0], np.cumsum(many)[:-1])).astype(np.int64)

    def bucket(keys: pa.Array, hashes: pa.Array) -> np.ndarray:
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        at = np.where(known, len(bounds) - np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False)), len(bounds) + 1)
        high = (hashes.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return (first[at] + (high * many[at] >> np.uint64(32)).astype(np.int64)).astype(np.int32)

    def only_buckets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(b.column(0), b.column(1))), b.column(0), b.column(1)], names=["bucket", "key", "h"])

    heads = picked.select("key", "h").mapInArrow(only_buckets, "bucket int, key long, h long")
    heads = sorted((r.bucket, (r.head.key, ~r.head.h)) for r in heads.groupBy("bucket").agg(F.max(F.struct("key", F.expr("~h").alias("h"))).alias("head")).collect())
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}  # the first row of a bucket goes to the one before it too

    def deal(batches):
        at = np.array(sorted(k for _, k in before), np.int64)  # hashes of the first rows
        for b in batches:
            own = bucket(b.column(0), b.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), bool)), b.column(0), b.column(1)], names=["bucket", "extra", "key", "text"])
            likely = np.flatnonzero(np.isin(b.column(2).to_numpy(zero_copy_only=False), at)).tolist()
            more = [(i, before[k]) for i in likely if (k := (b.column(0)[i].as_py(), b.column(2)[i].as_py())) in before]
            if more:
                take = pa.array([i for i, _ in more], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x in more], pa.int32()), pa.array([True] * len(more)), b.column(0).take(take), b.column(1).take(take)], names=["bucket", "extra", "key", "text"])

    dealt = picked.mapInArrow(deal, "bucket int, extra boolean, key long, text string")
    return dealt.repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "extra", F.col("key").desc_nulls_last(), h, F.coalesce("text", F.lit(""))), len(heads)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: its fingerprint, and how near it is to its edited text and to the next document.

    A fingerprint lists the digests of the text's chunks, each with the bytes it makes up (of repeated chunks the sum);
    likeness is the share of the text's bytes whose chunks the other fingerprint has too. The next document has the next
    smaller key (null keys last, equal keys in the order of their texts' hashes; after the last the first); the edited text has its
    last third replaced by the start of the next. Null texts count as empty, whose fingerprint is empty. Other columns don't
    matter; an empty table gives none. Rows are streamed: a task holds a few MB of texts and, to find the next one, one more.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows, _ = with_next(docs, key, text)

    def made(held: list[tuple]) -> pa.RecordBatch | None:
        """Results of the rows that are followed by another of their bucket."""
        use = [i for i in range(len(held) - 1) if not held[i][1] and held[i + 1][0] == held[i][0]]
        if not use:
            return None
        texts = [x[3] or "" for x in held]
        edited = []
        for i in use:
            a, k = texts[i], len(texts[i]) // 3
            edited.append((a[: len(a) - k] + texts[i + 1][:k]).encode())
        weights = chunk_weights([x.encode() for x in texts] + edited)
        changed = weights[len(texts) :]
        out = [(held[i][2], len(texts[i]), hashlib.sha256(e).hexdigest(), printed(weights[i]), printed(c), containment(weights[i], c), containment(weights[i], weights[i + 1])) for i, e, c in zip(use, edited, changed, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def stream(batches):
        held: list[tuple] = []
        for batch in pieces(batches, "text", 2 << 20):
            held += zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "key", "text")), strict=True)
            if out := made(held):
                yield out
            held = held[-1:]

    return rows.mapInArrow(stream, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
