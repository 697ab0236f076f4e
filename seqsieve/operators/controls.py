"""Verified sequences: length and stop fails, reading frames, ambiguous references (F-2, F-4, W-1, A-10, W-2, U-1, U-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import even_odds, length_passes, stop_codons, stop_count
from .prefix import running_sums


class ControlSetError(ValueError):
    """No verified authentic or non-authentic sequences."""


def length_fails(asvs: DataFrame, low: int | None, high: int | None, expected: int | None = None, by_codon: bool = False) -> DataFrame:
    return asvs.filter(~length_passes(F.length("seq"), low, high, expected, by_codon)).select("asv_id")


def stop_counts(asvs: DataFrame, table: int = 5) -> DataFrame:
    """Adds stops1, stops2 and stops3: the stop codons in each frame (X-5)."""
    codons = stop_codons(table)
    return asvs.select("*", *(stop_count(F.col("seq"), f, codons).alias(f"stops{f}") for f in (1, 2, 3)))


def frame_prefixes(asvs: DataFrame, table: int = 5) -> DataFrame:
    """(asv_ord, run_stops1..3, run_total, confidence) after each sequence in order."""
    cols = ["stops1", "stops2", "stops3"]
    runs = running_sums(stop_counts(asvs, table).select("asv_ord", *(F.col(c).cast("long").alias(c) for c in cols)), "asv_ord", cols)
    sums = [F.col(f"run_{c}") for c in cols]
    return runs.select("asv_ord", *sums, (sums[0] + sums[1] + sums[2]).alias("run_total"), even_odds(sums).alias("confidence"))


def detect_frame(asvs: DataFrame, table: int = 5, confidence: float = 0.95, least_stops: int = 100) -> DataFrame:
    """One row (asv_ord, frame): after the first sequence with enough stops so far, spread unevenly enough, the frame with
    the fewest, the first of equals. Empty if no sequence gets there."""
    if not 0 < confidence < 1:
        raise ValueError("confidence is between 0 and 1")
    done = frame_prefixes(asvs, table).filter((F.col("run_total") >= least_stops) & (F.col("confidence") >= confidence)).orderBy("asv_ord").limit(1)
    sums = F.array("run_stops1", "run_stops2", "run_stops3")
    return done.select("asv_ord", F.array_position(sums, F.array_min(sums)).cast("int").alias("frame"))


def stop_fails(asvs: DataFrame, frame: int, table: int = 5) -> DataFrame:
    return asvs.filter(stop_count(F.col("seq"), frame, stop_codons(table)) > 0).select("asv_id")


def resolve_ambiguous(hits: DataFrame, totals: DataFrame, ignore: bool = False) -> DataFrame:
    """(ref_id, asv_id): of several sequences that match one reference the most abundant, of equals the least id; with
    ignore, only references that one sequence matches (A-10, W-2)."""
    rows = hits.join(totals, "asv_id", "left").select("ref_id", "asv_id", F.coalesce("n", F.lit(0)).alias("n"))
    if ignore:
        alone = rows.groupBy("ref_id").agg(F.count("*").alias("_hits"), F.min("asv_id").alias("asv_id"))
        return alone.filter("_hits = 1").select("ref_id", "asv_id")
    # the greatest by (total, least id), combined before the shuffle
    best = rows.groupBy("ref_id").agg(F.max("n").alias("n"))
    return rows.join(best, ["ref_id", "n"]).groupBy("ref_id").agg(F.min("asv_id").alias("asv_id"))


def control_list(length: DataFrame, stops: DataFrame, matched: DataFrame) -> DataFrame:
    """(asv_id, reason): lengthfail, stopfail, and refpass for matches that failed neither (K-5, U-1, U-2)."""
    bad = length.union(stops).distinct()
    passed = matched.select("asv_id").distinct().join(bad, "asv_id", "left_anti")
    tag = lambda df, reason: df.select("asv_id", F.lit(reason).alias("reason")).distinct()
    return tag(length, "lengthfail").union(tag(stops, "stopfail")).union(tag(passed, "refpass"))


def with_controls(asvs: DataFrame, controls: DataFrame) -> DataFrame:
    """Adds is_target (refpass) and is_nontarget (any fail)."""
    flags = controls.groupBy("asv_id").agg(F.bool_or(F.col("reason") == "refpass").alias("is_target"), F.bool_or(F.col("reason") != "refpass").alias("is_nontarget"))
    no = F.lit(False)
    return asvs.join(flags, "asv_id", "left").withColumn("is_target", F.coalesce("is_target", no)).withColumn("is_nontarget", F.coalesce("is_nontarget", no))


def require_controls(flagged: DataFrame) -> None:
    t, n = flagged.agg(F.count_if("is_target"), F.count_if("is_nontarget")).first()
    if not t or not n:
        raise ControlSetError(f"{t} verified authentic and {n} non-authentic sequences; both are needed")
