"""SimHash near-dedup: candidates by pigeonring filtering, links by shared one-bit neighbours, classes by components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, pieces, stored

BITS = 64
#: Segments of a fingerprint, laid in a ring.
SEGMENTS = 16


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, joined by single spaces; of fewer words, of the whole sequence; of none, nothing."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def simhash(hashes: list[np.ndarray]) -> np.ndarray:
    """A 64-bit fingerprint for each list: the bits set in over half of its hashes."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        every = np.concatenate(hashes)
        starts = (np.cumsum(sizes) - sizes)[some]
        bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * counts > sizes[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """All columns of docs but the text and one of the name `out`, then `out`: the 64-bit SimHash as a long. Null and empty
    texts have 0."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in (text, out)]

    def run(batches):
        for batch in pieces(batches, text, 1 << 20):
            got = simhash([shingle_hashes((x or "").encode(), width) for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got.view(np.int64))], names=[*keep, out])

    picked = docs.select(*keep, text)
    return picked.mapInArrow(run, T.StructType([*picked.select(*keep).schema, T.StructField(out, T.LongType())]))


def chain_length(most: int, segments: int = SEGMENTS) -> int:
    """Pigeonring: of two fingerprints within `most` bits some chain of segments starts so that the differences of its first
    l segments are at most l * most / segments, for every l. As long as that is under 1, these l segments are equal."""
    return next(n for n in range(segments, -1, -1) if n * most < segments)


def ring_keys(fp: Column, most: int, segments: int = SEGMENTS) -> Column:
    """For each start of a chain: struct(start, the bits of its equal segments)."""
    width, n = BITS // segments, chain_length(most, segments)
    keys = []
    for start in range(segments):
        turned = fp if start == 0 else F.shiftleft(fp, start * width).bitwiseOR(F.shiftrightunsigned(fp, BITS - start * width))
        keys.append(F.struct(F.lit(start).alias("start"), F.shiftrightunsigned(turned, BITS - n * width).alias("chain")))
    return F.array(*keys)


def within_budget(fps: DataFrame, most: int) -> DataFrame:
    """The distinct fingerprints (column fp) that share an equal chain with another one; the rest can have no link."""
    width, n = BITS // SEGMENTS, chain_length(most)
    if n == 0:
        return fps
    keyed = fps.select("fp", F.explode(ring_keys(F.col("fp"), most)).alias("key"))
    # of a chain the first budget over 1 allows one differing bit in the segments up to it: at start i they hold as many set
    # bits, give or take one. Chains without a partner of such a count go.
    after = F.expr(f"shiftrightunsigned(fp, cast(({SEGMENTS - 1} - (key.start + {n}) % {SEGMENTS}) * {width} as int))")
    ones = F.bit_count(after.bitwiseAND((1 << width) - 1)).cast("int")
    grouped = keyed.withColumn("ones", ones).groupBy("key").agg(F.count("*").alias("n"), *(F.sum((F.col("ones") == i).cast("long")).alias(f"n{i}") for i in range(width + 1)))
    grouped = grouped.filter("n > 1").select("key", F.array(*(f"n{i}" for i in range(width + 1))).alias("by_ones"))
    kept = keyed.withColumn("ones", ones).join(stored(grouped, "chains"), "key")  # stored: a hot chain's join can be split
    near = F.get(F.col("by_ones"), F.col("ones") - 1), F.get(F.col("by_ones"), F.col("ones")), F.get(F.col("by_ones"), F.col("ones") + 1)
    return kept.filter(sum(F.coalesce(x, F.lit(0)) for x in near) > 1).select("fp").distinct()


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints (column fp, long) within `most` (1 or 2) bits into the same components.

    Pairs aren't listed, as a large group of near copies has the square of its size of them. Two fingerprints are within two
    bits just if flipping at most one bit of each can give the same number (of one bit: if flipping one bit of either gives
    the other). Each fingerprint that passes the filter sends itself and, for two bits, its 64 neighbours as keys; under
    each key the others are linked to the least: an exact Hamming check that is linear in their number.
    """
    if most not in (1, 2):
        raise ValueError("most must be 1 or 2")
    survivors = stored(within_budget(fps, most), "survivors")
    masks = F.array(*(F.lit(0 if i < 0 else (1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(-1, BITS)))
    each = survivors.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))
    if most == 1:
        return each.filter("key != fp").join(survivors.select(F.col("fp").alias("key")), "key", "left_semi").select(F.greatest("fp", "key").alias("a"), F.least("fp", "key").alias("b")).distinct()
    least = each.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("a"), F.count("*").alias("n"))
    shared = stored(least.filter("n > 1"), "shared")
    pairs = shared.filter("n = 2").select("a", "b")  # most keys have two: no need to look them up again
    more = each.join(shared.filter("n > 2").select("key", "b"), "key").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.union(more).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """A row for each row of docs: the key, its fingerprint (long) and component_id, the smallest key that it reaches over
    links of at most `most` differing bits. Null and empty texts have fingerprint 0, linked as any other. A null key stays;
    a class of null keys only has a null id. Other columns don't matter; an empty table gives none."""
    rows = stored(fingerprints(docs.select(key, text), text, "fingerprint", width), "simhash")
    fps = stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least")), "distinct")
    parts = components(links(fps.select("fp"), most))
    least = fps.join(parts, fps.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = stored(least, "parts")
    by_part = least.groupBy("part").agg(F.min("least").alias("component_id"))
    named = least.join(by_part, "part").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
