"""All threshold sets of a grid at once: rejects, confusion matrix, ratios, estimates, fingerprints (F-5, F-6, J-6, A-5 to A-7, A-15).

A sequence is rejected if its score in any of a set's specs is below the threshold; without a score it isn't. For each
additive term only its own specs matter. A sequence's score falls between two of the spec's thresholds; sequences are
counted by these places (cells), and the retained of every set are sums over the cells at or above its thresholds: one
running sum along each spec over the lattice of cells. The work is that of the lattice, which has as many points as the
term has sets, and of one pass over the sequences; sequences and sets are never paired.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..specs import Grid, threshold_column, threshold_sets

#: Sums of a cell: all, targets, non-targets, others' hashes in halves (so that sums can't overflow), others.
_SUMS = ("n", "t", "nt", "lo", "hi", "o")


def place(score: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds are at most the score; all of them without a score."""
    return F.coalesce(F.when(score.isNull(), F.lit(len(thresholds))), F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= score)))


def _cells(scored: DataFrame, names: list[str], levels: list[list[float]]) -> DataFrame:
    h = F.xxhash64(F.col("asv_id").cast("string"))
    other = ~F.col("is_target") & ~F.col("is_nontarget")
    zero = F.lit(0).cast("long")
    places = [place(F.col(f"`{n}`"), v).alias(f"k{i}") for i, (n, v) in enumerate(zip(names, levels, strict=True))]
    return scored.groupBy(*places).agg(
        F.count("*").alias("n"), F.count_if("is_target").alias("t"), F.count_if(F.col("is_nontarget") & ~F.col("is_target")).alias("nt"),
        F.sum(F.when(other, h.bitwiseAND(0xFFFFFFFF)).otherwise(zero)).alias("lo"), F.sum(F.when(other, F.shiftrightunsigned(h, 32)).otherwise(zero)).alias("hi"), F.count_if(other).alias("o"),
    )


def _retained(scored: DataFrame, names: list[str], levels: list[list[float]]) -> DataFrame:
    """For each point of the lattice (k0, k1, ...) the sums over all cells that are at or above it in every spec."""
    spark = scored.sparkSession
    sides = [spark.range(len(v) + 1).select(F.col("id").cast("int").alias(f"k{i}")) for i, v in enumerate(levels)]
    lattice = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sides)  # the grid itself, bounded by its specification
    keys = [f"k{i}" for i in range(len(levels))]
    points = lattice.join(_cells(scored, names, levels), keys, "left").na.fill(0, list(_SUMS))
    for i, k in enumerate(keys):
        upward = Window.partitionBy(*(keys[:i] + keys[i + 1 :])).orderBy(F.col(k).desc()).rowsBetween(Window.unboundedPreceding, 0)
        points = points.select(*keys, *(F.sum(s).over(upward).alias(s) for s in _SUMS))
    return points


def retained_sums(scored: DataFrame, grid: Grid) -> DataFrame:
    """threshold_sets(), with r_n, r_t, r_nt, r_o: retained of all, targets, non-targets, others; r_lo, r_hi: others' hashes;
    and a_n to a_hi, the same of all sequences, which are the sums at the lattice's origin, the greatest."""
    sets, out, offset = threshold_sets(scored.sparkSession, grid), None, 0
    for i, size in enumerate(grid.sizes()):
        names = grid.used(i)
        levels = [sorted(set(grid.terms[i][n])) for n in names]
        own = sets.filter((F.col("resultindex") >= offset) & (F.col("resultindex") < offset + size))
        for j, (n, v) in enumerate(zip(names, levels, strict=True)):
            # the k-th threshold keeps the sequences placed at k or above
            own = own.withColumn(f"k{j}", F.array_position(F.array(*map(F.lit, v)), F.col(f"`{threshold_column(n)}`")).cast("int"))
        keys = [f"k{j}" for j in range(len(names))]
        points = _retained(scored, names, levels)
        whole = points.agg(*(F.max(s).alias(f"a_{s}") for s in _SUMS))  # one row
        joined = own.join(points.withColumnsRenamed({s: f"r_{s}" for s in _SUMS}), keys).drop(*keys).crossJoin(F.broadcast(whole))
        out, offset = joined if out is None else out.unionByName(joined), offset + size
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (A-6)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_scores(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {"accuracy_score": ratio(tp + tn, tp + tn + fp + fn), "precision_score": ratio(tp, tp + fp), "recall_score": ratio(tp, tp + fn)}


def estimates(total: Column, retained: Column, tp: Column, targets: Column, fp: Column, nontargets: Column) -> dict[str, Column]:
    """Sizes of the true populations (A-7): with retention rates of the controls r_t and r_n, the authentic number is
    (retained - total * r_n) / (r_t - r_n). All null where any division fails."""
    d = lambda x: x.cast("double")
    rt, rn = F.try_divide(d(tp), d(targets)), F.try_divide(d(fp), d(nontargets))
    authentic = F.try_divide(d(retained) - d(total) * rn, rt - rn)
    kept, other = authentic * rt, rn * (d(total) - authentic)
    every = {"authentic_total_estimate": authentic, "nonauthentic_total_estimate": d(total) - authentic, "authentic_retained_estimate_n": kept, "nonauthentic_retained_estimate_n": other}
    every |= {"authentic_retained_estimate_p": F.try_divide(kept, d(retained)), "nonauthentic_retained_estimate_p": F.try_divide(other, d(retained))}
    sound = reduce(lambda a, b: a & b, (v.isNotNull() for v in every.values()))
    return {k: F.when(sound, v) for k, v in every.items()}


def sweep(scored: DataFrame, grid: Grid) -> DataFrame:
    """A row for each threshold set: resultindex, term, thresholds, scores, counts and shares, estimates, rejects_hash.

    scored: asv_id, is_target, is_nontarget and a score column per spec. Actual rejects are the rejected and all non-targets,
    but no target. rejects_hash is the same for sets whose actual rejects are the same (the halves' sums of the rejected
    others and the number of rejects are hashed; all sets share the non-targets).
    """
    x = retained_sums(scored, grid)
    c = F.col
    n, targets, nontargets = c("a_n"), c("a_t"), c("a_nt")
    tp, fp = c("r_t"), c("r_nt")
    fn, tn = targets - tp, nontargets - fp
    rejected = c("a_o") - c("r_o") + nontargets
    cols: dict[str, Column] = confusion_scores(tp, fp, tn, fn)
    cols |= {"asvs_total": n, "verifiedauthentic_total_observed": targets, "verifiednonauthentic_total_observed": nontargets}
    for name, kept, of in (("asvsprelim", c("r_n"), n), ("verifiedauthentic", tp, targets), ("verifiednonauthentic", fp, nontargets), ("asvsactual", n - rejected, n)):
        cols |= {f"{name}_retained_n": kept, f"{name}_retained_p": ratio(kept, of), f"{name}_rejected_n": of - kept, f"{name}_rejected_p": ratio(of - kept, of)}
    cols |= estimates(n, c("r_n"), tp, targets, fp, nontargets)
    cols["rejects_hash"] = F.xxhash64(rejected, c("a_lo") - c("r_lo"), c("a_hi") - c("r_hi"))
    own = ["resultindex", "term", *(f"`{threshold_column(s)}`" for s in grid.names())]
    return x.select(*own, *(v.alias(k) for k, v in cols.items()))


def rejects(scored: DataFrame, sets: DataFrame, names: list[str], keep: str = "asv_id") -> DataFrame:
    """(resultindex, asv_id, or the column `keep`) of the actual rejects of a few chosen sets (F-6, U-3): rows of threshold_sets().
    The output is as large as sets by rejects. A set's thresholds are looked up where a sequence is: each sequence has the list of
    the sets that reject it, made from a one-row list of the chosen sets."""
    below = lambda x: reduce(lambda a, b: a | b, (F.coalesce(F.col(f"`{n}`") < x[f"t{i}"], F.lit(False)) for i, n in enumerate(names)))
    chosen = sets.agg(F.collect_list(F.struct("resultindex", *(F.col(f"`{threshold_column(n)}`").alias(f"t{i}") for i, n in enumerate(names)))).alias("_chosen"))
    own = scored.filter(~F.col("is_target")).crossJoin(F.broadcast(chosen))  # one row
    return own.select(F.explode(F.filter("_chosen", lambda x: below(x) | F.col("is_nontarget"))).alias("_set"), keep).select("_set.resultindex", keep)
