"""The whole search: sequences, counts, groups and controls to scored threshold sets, and what chosen sets retain."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import length_bounds
from ..operators import binning, clades, controls, linkage, refmatch, select, sweep, trees
from ..sources import files
from ..specs import Grid, parse_specs, single_set, threshold_sets
from . import resume


@dataclass
class Inputs:
    """Tables of a run: asvs (asv_ord, asv_id, asv_key, header, seq), counts, and groups by part."""

    asvs: DataFrame
    counts: DataFrame
    groups: dict[str, DataFrame]


def load(spark: SparkSession, asv_path: str, readmap: str | None = None, libraries: list[str] | None = None, taxa: str | None = None, tree: str | None = None, divergence: float = 0.2, model: str = "F84", want_clades: bool = False, keep: str | None = None) -> Inputs:
    """Reads the inputs. Counts come from a table or from read files (one of the two); clades from a Newick tree, else from
    the sequences, which must then be of one length, as aligned ones are (H-1, O-2). keep: a folder where clades are kept for
    later runs of the same sequences, tree, height and model."""
    if (readmap is None) == (libraries is None):
        raise ValueError("give a count table or read files")
    raw = files.numbered(files.read_fasta(spark, asv_path))
    files.check_unique(raw, "asv_id")
    asvs = raw.withColumn("aligned_seq", F.upper("seq")).withColumn("seq", F.upper(F.translate("seq", "-", "")))
    if readmap:
        counts = files.read_counts(spark, readmap, asvs)
    else:
        files.check_unique(asvs, "seq")
        reads = files.read_reads(spark, libraries)
        matched = files.match_reads(reads, asvs)
        if bare := [r.library for r in files.libraries_without_hits(reads, matched).limit(20).collect()]:
            warnings.warn(f"no read of these libraries equals a sequence: {', '.join(sorted(bare))}", stacklevel=2)
        counts = binning.count_reads(matched)
        if gone := asvs.join(counts, "asv_id", "left_anti").first():
            raise files.FormatError(f"{gone.asv_id!r} is in no library")
    groups = {}
    if taxa:
        groups["taxon"] = files.read_taxa(spark, taxa, asvs)
    if tree or want_clades:

        def made() -> DataFrame:
            if tree:
                # tips may have "-" for ";": known names are translated, not every "-"
                known = asvs.select("asv_id", F.replace("asv_id", F.lit(";"), F.lit("-")).alias("name"))
                tips = trees.cut(trees.read_tree(spark, tree), divergence).select("name", F.col("clade").cast("string").alias("group_id"))
                return tips.join(known, "name", "left").select("group_id", F.coalesce("asv_id", "name").alias("asv_id"))
            if not files.is_aligned(asvs.select("asv_ord", F.col("aligned_seq").alias("seq"))):
                raise files.FormatError("clades need aligned sequences or a tree")
            own, _ = linkage.linkage(asvs.select("asv_ord", F.col("aligned_seq").alias("seq")), divergence, model)
            return asvs.join(own, "asv_ord").select(F.col("clade").cast("string").alias("group_id"), "asv_id")

        if keep:
            stamp = {"asvs": resume.digest(spark, asv_path), "tree": tree and resume.digest(spark, tree), "divergence": divergence, "model": None if tree else model}
            groups["clade"] = resume.resumed(spark, keep, "clades", stamp, made)
        else:
            groups["clade"] = made()
    return Inputs(asvs, counts, groups)


def whole_tree(inputs: Inputs, model: str = "F84") -> DataFrame:
    """The whole average-linkage tree of aligned sequences, as trees.read_tree() has it; trees.newick_lines() is its text (K-6)."""
    rows = inputs.asvs.select("asv_ord", F.col("aligned_seq").alias("seq"))
    _, merges = linkage.linkage(rows, float("inf"), model)
    return trees.tree_of(merges, inputs.asvs.select("asv_ord", F.replace("asv_id", F.lit(";"), F.lit("-")).alias("name")))


def find_controls(inputs: Inputs, references: DataFrame, bounds: tuple[int | None, int | None], table: int = 5, frame: int | None = None, confidence: float = 0.95, least_stops: int = 100, least_match: int | None = None, ignore_ambiguous: bool = False, expected: int | None = None, by_codon: bool = False) -> DataFrame:
    """(asv_id, reason). references: (ref_id, ref_seq). Without a frame it is detected. Matches need 0.8 of the least length."""
    asvs = inputs.asvs
    short = controls.length_fails(asvs, *bounds, expected, by_codon)
    if frame is None:
        found = controls.detect_frame(asvs, table, confidence, least_stops).first()
        if found is None:
            raise controls.ControlSetError("too few stops, or too even, to tell the reading frame")
        frame = found.frame
    stops = controls.stop_fails(asvs, frame, table)
    hits = refmatch.reference_hits(asvs, references, least_match or int(0.8 * (bounds[0] or 0)) or 1)
    matched = controls.resolve_ambiguous(hits, binning.total_counts(inputs.counts, asvs), ignore_ambiguous)
    return controls.control_list(short, stops, matched)


def find(inputs: Inputs, controls_: DataFrame, specification: str, anyfail: bool = False) -> tuple[DataFrame, DataFrame, Grid]:
    """Results of all threshold sets, the scores they rest on, and the grid."""
    grid = parse_specs(specification)
    flagged = controls.with_controls(inputs.asvs.select("asv_ord", "asv_id"), controls_)
    controls.require_controls(flagged)
    scored = binning.wide_scores(flagged, inputs.counts, inputs.groups, grid.specs, anyfail).cache()
    return sweep.sweep(scored, grid), scored, grid


def store_of(scored: DataFrame, grid: Grid, indices: list[int]) -> DataFrame:
    """The result store of chosen sets."""
    sets = threshold_sets(scored.sparkSession, grid).filter(F.col("resultindex").isin(indices))
    return select.encode_store(sweep.rejects(scored, sets, grid.names(), "asv_ord"), scored.select("asv_ord"))


def dump_cached(asvs: DataFrame, store: DataFrame, indices: list[int], hashes: DataFrame | None = None) -> DataFrame:
    """(resultindex, sequences) that stored sets retain. With the hash store also of sets that aren't stored, if one with the
    same rejects is."""
    if hashes is None:
        return select.retained_from_store(asvs, store.filter(F.col("resultindex").isin(indices)))
    wanted = asvs.sparkSession.createDataFrame([(i,) for i in sorted(set(indices))], "resultindex long")
    twins = select.stored_twins(wanted, hashes, store)
    kept = select.retained_from_store(asvs, store.join(twins.select(F.col("stored").alias("resultindex")).distinct(), "resultindex", "left_semi"))
    return twins.join(kept.withColumnRenamed("resultindex", "stored"), "stored").drop("stored")


def dump_spec(inputs: Inputs, terms: list[str], anyfail: bool = False) -> DataFrame:
    """Sequences that one specification retains, no controls heeded."""
    grid = single_set(terms)
    flagged = inputs.asvs.select("asv_ord", "asv_id").withColumn("is_target", F.lit(False)).withColumn("is_nontarget", F.lit(False))
    scored = binning.wide_scores(flagged, inputs.counts, inputs.groups, grid.specs, anyfail)
    out = sweep.rejects(scored, threshold_sets(scored.sparkSession, grid), grid.names())
    return select.retained(inputs.asvs, out)


def filter_translate(asvs: DataFrame, frame: int | None = None, table: int = 5, confidence: float = 0.95, least_stops: int = 50) -> DataFrame:
    """asvs with passes: whether the reading frame has no stop (K-8)."""
    if frame is None:
        found = controls.detect_frame(asvs, table, confidence, least_stops).first()
        if found is None:
            raise controls.ControlSetError("too few stops, or too even, to tell the reading frame")
        frame = found.frame
    fails = controls.stop_fails(asvs, frame, table).withColumn("_f", F.lit(True))
    return asvs.join(fails, "asv_id", "left").withColumn("passes", F.col("_f").isNull()).drop("_f")


def filter_length(asvs: DataFrame, by_codon: bool = False, **lengths) -> DataFrame:
    """asvs with passes: whether the length is in the bounds (K-8, Q15)."""
    bounds = length_bounds(**lengths)
    fails = controls.length_fails(asvs, *bounds, lengths.get("expected"), by_codon).withColumn("_f", F.lit(True))
    return asvs.join(fails, "asv_id", "left").withColumn("passes", F.col("_f").isNull()).drop("_f")


def analyse(results: DataFrame, names: list[str], metric: str = "accuracy_score", fp: float = 1.0, fn: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The best distinct sets within error rates, and the single-spec sets in long form (entry E)."""
    best = select.best_sets(select.within_rates(results, fp, fn), metric).dropDuplicates(["rejects_hash"])
    return best, select.long_stats(results, names)
