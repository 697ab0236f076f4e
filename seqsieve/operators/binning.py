"""Counts by bin, as numbers or proportions, and one score per sequence (J-2, A-1 to A-4, W-3, F-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..specs import Spec


def count_reads(reads: DataFrame) -> DataFrame:
    """(library, asv_id, n) from one row per matched read (A-1)."""
    return reads.groupBy("library", "asv_id").agg(F.count("*").alias("n"))


def total_counts(counts: DataFrame, asvs: DataFrame | None = None) -> DataFrame:
    """(asv_id, n); with asvs, those without reads count 0 (A-2, D4)."""
    total = counts.groupBy("asv_id").agg(F.sum("n").alias("n"))
    if asvs is None:
        return total
    return asvs.select("asv_id").join(total, "asv_id", "left").select("asv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def binned(counts: DataFrame, memberships: dict[str, DataFrame], spec: Spec) -> DataFrame:
    """(library or total, part columns, asv_id, n): each count in each of its bins (J-2).

    counts: (library, asv_id, n); memberships: by part, (group_id, asv_id). A part without a membership is one group, "x".
    A sequence in several groups counts in each; one in none is in no bin of the spec. Counts without a library or sequence
    are left out, which also lets a later join of totals reuse the counts' shuffle.
    """
    counts = counts.filter("n > 0 and library is not null and asv_id is not null")
    rows = counts.select("library", "asv_id", "n") if spec.base == "library" else total_counts(counts).select(F.lit("total").alias("total"), "asv_id", "n")
    for part in spec.parts:
        if part in memberships:
            rows = rows.join(memberships[part].select("asv_id", F.col("group_id").alias(part)), "asv_id")
        else:
            rows = rows.withColumn(part, F.lit("x"))
    return rows.select(spec.base, *spec.parts, "asv_id", "n")


def bin_values(counts: DataFrame, memberships: dict[str, DataFrame], spec: Spec) -> DataFrame:
    """binned() with value: the number, or its share of the bin's total (A-3, W-3). An empty bin's shares are 0.

    Totals are aggregated and joined rather than windowed: a bin of any size then needs no single task."""
    rows = binned(counts, memberships, spec)
    if spec.metric == "n":
        return rows.withColumn("value", F.col("n").cast("double"))
    keys = [spec.base, *spec.parts]
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("bin_total"))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("bin_total").cast("double")), F.lit(0.0))
    return rows.join(totals, keys).withColumn("value", share).select(*keys, "asv_id", "n", "value")


def scores(counts: DataFrame, memberships: dict[str, DataFrame], spec: Spec, anyfail: bool = False) -> DataFrame:
    """(asv_id, score): the number that every threshold is held against: the greatest value (a sequence goes if all of its
    values are below), or with anyfail the least."""
    pick = F.min if anyfail else F.max
    return bin_values(counts, memberships, spec).groupBy("asv_id").agg(pick("value").alias("score"))


def wide_scores(asvs: DataFrame, counts: DataFrame, memberships: dict[str, DataFrame], specs: list[Spec], anyfail: bool = False) -> DataFrame:
    """asvs (asv_id and more) with a score column for each spec, named as the spec; null where it is in no bin (A-4).

    Specs that share their bins are measured together: one pass over the binned counts gives numbers and shares."""
    pick, out = F.min if anyfail else F.max, asvs
    for base, parts in dict.fromkeys((s.base, s.parts) for s in specs):
        own = [s for s in specs if (s.base, s.parts) == (base, parts)]
        shares = next((s for s in own if s.metric == "p"), None)
        rows = bin_values(counts, memberships, shares or own[0])
        measured = {"n": F.col("n").cast("double"), "p": F.col("value")}
        out = out.join(rows.groupBy("asv_id").agg(*(pick(measured[s.metric]).alias(s.name) for s in own)), "asv_id", "left")
    return out


def library_size_histogram(counts: DataFrame) -> DataFrame:
    """(n_asvs, libraries): how many libraries have so many sequences (A-8)."""
    return counts.filter("n > 0").groupBy("library").agg(F.count("*").alias("n_asvs")).groupBy("n_asvs").agg(F.count("*").alias("libraries"))


def counts_matrix(counts: DataFrame, asv_ids: list) -> DataFrame:
    """A row per library, a 0-filled column per sequence in the given order (K-1)."""
    return counts.groupBy("library").pivot("asv_id", asv_ids).agg(F.sum("n")).na.fill(0)
