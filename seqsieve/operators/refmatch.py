"""Sequences that stand in references: perfect but for N in the reference and for what hangs over its ends (H-2, J-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .rounds import stored

#: A window's bases, at most; a seed is two thirds of it. References with N are looked up by windows of as few as LEAST_WINDOW.
WINDOW, LEAST_WINDOW = 24, 8


def _seed(window: int) -> int:
    return max(1, 2 * window // 3)


def _clean_run(ref: Column, least: int) -> Column:
    """The bases without N that stand together in any stretch of `least` of ref, at least."""
    longest = lambda i: F.array_max(F.transform(F.split(F.substring(ref, i, F.lit(least)), "N+"), lambda x: F.length(x)))
    return F.array_min(F.transform(F.sequence(F.lit(1), F.length(ref) - least + 1), longest))


def _seeds(seq: Column, start: Column, stop: Column, seed: int, window: int) -> Column:
    """Minimizers (hash, at) of the windows of seq that start at start to stop (from 1): of the seeds in a window the least hash,
    the first of equals. Two sequences that are the same over a window share its minimizer."""
    hashes = lambda i: F.transform(F.sequence(i, i + (window - seed)), lambda j: F.struct(F.xxhash64(F.substring(seq, j, F.lit(seed))).alias("hash"), j.alias("at")))
    every = F.transform(F.sequence(start, stop), lambda i: F.array_min(hashes(i)))
    return F.array_distinct(F.when(stop >= start, every).otherwise(F.array().cast("array<struct<hash: bigint, at: int>>")))


def _fits(seq: Column, ref: Column, shift: Column, least: int) -> Column:
    """Whether seq, put on ref with its first base at shift (from 0, may be negative), has at least `least` bases on it that all
    are as in ref or stand on an N."""
    first = F.greatest(F.lit(0), -shift)
    n = F.least(F.length(seq), F.length(ref) - shift) - first
    own, other = F.substring(seq, first + 1, n), F.substring(ref, first + shift + 1, n)
    return (n >= least) & F.when(F.contains(other, F.lit("N")), F.rlike(own, F.concat(F.lit("^"), F.replace(other, F.lit("N"), F.lit(".")), F.lit("$")))).otherwise(own == other)


def reference_hits(asvs: DataFrame, references: DataFrame, least_length: int) -> DataFrame:
    """(asv_id, ref_id): sequences with at least least_length bases on a reference, on either strand, all of which are as in the
    reference or stand on an N of it; bases beyond its ends hang over and don't count.

    asvs: (asv_id, seq); references: (ref_id, ref_seq), both upper case, letters only; null sequences match none. Equal rows count
    once. A match of least_length bases holds a whole block of the sequence, when that is cut in blocks of half as many. Of each
    block's minimizers only the one that the references have least often is looked up, so that what all references share, as
    simple or conserved stretches, is hardly ever joined by. References with N may lack it: they are looked up by all minimizers
    of the sequence, of windows as long as the N leave room for in any match; a match then has one of them. Where that is under
    LEAST_WINDOW, all sequences are compared."""
    window = max(1, min(WINDOW, least_length // 2))
    seed, block = _seed(window), max(1, least_length // 2)
    asvs = asvs.select("asv_id", "seq").filter(F.length("seq") >= least_length).distinct()
    both = references.select("ref_id", "ref_seq", F.lit(False).alias("turned")).union(references.select("ref_id", reverse_complement(F.col("ref_seq")), F.lit(True)))
    both = both.filter(F.length("ref_seq") >= least_length).distinct()
    clean = ~F.contains("ref_seq", F.lit("N"))
    both = both.withColumn("room", F.when(clean, F.lit(window)).otherwise(F.least(_clean_run(F.col("ref_seq"), least_length), F.lit(window))))
    both = stored(both.withColumn("kind", F.when(clean, "clean").when(F.col("room") >= min(LEAST_WINDOW, window), "some").otherwise("poor")), "references")
    rooms = [r.room for r in both.filter("kind = 'some'").select("room").distinct().collect()]  # WINDOW numbers at most

    def known(kind: str, window: int) -> DataFrame:
        """The minimizers of the references of a kind, those with N of a window's room."""
        seed = _seed(window)
        own = both.filter((F.col("kind") == kind) & (F.col("room") == window)).withColumn("s", F.explode(_seeds(F.col("ref_seq"), F.lit(1), F.length("ref_seq") - window + 1, seed, window)))
        own = own.select("ref_id", "ref_seq", "turned", F.col("s.hash").alias("hash"), F.col("s.at").alias("at"))
        return own.filter(~F.contains(F.substring("ref_seq", F.col("at"), F.lit(seed)), F.lit("N")))

    # clean references: the rarest minimizer of each block
    starts = F.sequence(F.lit(1), F.length("seq") - block + 1, F.lit(block))
    blocks = asvs.select("asv_id", "seq", F.explode(F.when(F.length("seq") >= block, starts)).alias("block"))
    own = blocks.select("asv_id", "seq", "block", F.explode(_seeds(F.col("seq"), F.col("block"), F.col("block") + (block - window), seed, window)).alias("s"))
    own = own.select("asv_id", "seq", "block", F.col("s.hash").alias("hash"), F.col("s.at").alias("own_at"))
    counts = known("clean", window).groupBy("hash").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "hash", "left").groupBy("asv_id", "seq", "block").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "own_at")).alias("s")).filter("s.n > 0")
    looked = rarest.select("asv_id", "seq", "s.hash", "s.own_at").join(known("clean", window), "hash").select("asv_id", "seq", "ref_id", "ref_seq", "turned", "at", "own_at")
    # references with N: all minimizers of the sequence
    for room in sorted(rooms):
        whole = asvs.select("asv_id", "seq", F.explode(_seeds(F.col("seq"), F.lit(1), F.length("seq") - room + 1, _seed(room), room)).alias("s"))
        whole = whole.select("asv_id", "seq", F.col("s.hash").alias("hash"), F.col("s.at").alias("own_at"))
        looked = looked.union(whole.join(known("some", room), "hash").select("asv_id", "seq", "ref_id", "ref_seq", "turned", "at", "own_at"))
    shift = (F.col("at") - F.col("own_at")).alias("shift")
    hits = looked.select("asv_id", "seq", "ref_id", "ref_seq", shift).filter(_fits(F.col("seq"), F.col("ref_seq"), F.col("shift"), least_length)).select("asv_id", "ref_id")
    # references that are N nearly everywhere: each with all sequences, dealt out in a grid
    side = 16
    poor = both.filter("kind = 'poor'").select("ref_id", "ref_seq", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("deal"))
    every = poor.join(asvs.withColumn("deal", F.pmod(F.xxhash64("asv_id"), F.lit(side)).cast("int")), "deal")
    every = every.withColumn("shift", F.explode(F.sequence(least_length - F.length("seq"), F.length("ref_seq") - least_length)))
    return hits.union(every.filter(_fits(F.col("seq"), F.col("ref_seq"), F.col("shift"), least_length)).select("asv_id", "ref_id")).distinct()
