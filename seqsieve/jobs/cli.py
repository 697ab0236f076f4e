"""Command line: find, dump, translate and length."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import length_bounds
from ..operators import select
from ..sources import files
from . import find as jobs
from . import resume


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqsieve", description=__doc__, fromfile_prefix_chars="@")
    modes = top.add_subparsers(dest="mode", required=True)

    def lengths(p: argparse.ArgumentParser) -> None:
        for flag, kind in (("--minimum", int), ("--maximum", int), ("--expected", int), ("--bases", int), ("--percent", float), ("--codons", int)):
            p.add_argument(flag, type=kind)
        p.add_argument("--by-codon", action="store_true")

    def frame(p: argparse.ArgumentParser, least: int) -> None:
        p.add_argument("--table", type=int, default=5)
        p.add_argument("--frame", type=int, choices=(1, 2, 3))
        p.add_argument("--confidence", type=float, default=0.95)
        p.add_argument("--least-stops", type=int, default=least)

    for mode in ("find", "dump"):
        p = modes.add_parser(mode)
        p.add_argument("--asvs", required=True)
        p.add_argument("--readmap")
        p.add_argument("--libraries", nargs="+")
        p.add_argument("--taxa")
        p.add_argument("--tree")
        p.add_argument("--divergence", type=float, default=0.2)
        p.add_argument("--model", default="F84")
        p.add_argument("--anyfail", action="store_true")
        p.add_argument("--output", required=True)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--keep", help="a folder where clades and controls are kept, and taken from if inputs and options are the same")
        if mode == "find":
            p.add_argument("--specification", required=True, help="file")
            known = p.add_mutually_exclusive_group(required=True)
            known.add_argument("--references")
            known.add_argument("--controls", help="lines of reason and sequence, as find writes them, in place of looking for controls")
            p.add_argument("--least-match", type=int)
            p.add_argument("--ignore-ambiguous", action="store_true")
            p.add_argument("--metric", default="accuracy", choices=("accuracy", "precision", "recall"))
            p.add_argument("--top", type=float, help="share of distinct scores whose sets are stored")
            lengths(p)
            frame(p, 100)
        else:
            p.add_argument("--store", help="a folder that find wrote, or a text file of indices, actions and sequences")
            p.add_argument("--hashes", help="the folder of hashes that find wrote: sets that aren't stored are told by others of the same rejects")
            p.add_argument("--index", type=int, nargs="+")
            p.add_argument("--specification", nargs="+", help="terms")
    for mode in ("translate", "length"):
        p = modes.add_parser(mode)
        p.add_argument("--asvs", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--overwrite", action="store_true")
        frame(p, 50) if mode == "translate" else lengths(p)
    return top


def _lengths(a: argparse.Namespace) -> dict:
    return {"minimum": a.minimum, "maximum": a.maximum, "expected": a.expected, "bases": a.bases, "percent": a.percent, "codons": a.codons}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqsieve").getOrCreate()
    mode = "overwrite" if a.overwrite else "error"
    if a.mode in ("translate", "length"):
        rows = files.numbered(files.read_fasta(spark, a.asvs)).withColumn("seq", F.upper(F.translate("seq", "-", "")))
        if a.mode == "translate":
            rows = jobs.filter_translate(rows, a.frame, a.table, a.confidence, a.least_stops)
        else:
            rows = jobs.filter_length(rows, a.by_codon, **_lengths(a))
        for name, keep in (("pass", rows.filter("passes")), ("fail", rows.filter("not passes"))):
            files.fasta_lines(keep).write.mode(mode).text(f"{a.output}/{name}")
        return
    text = "*".join(a.specification or []) if a.mode == "dump" else "\n".join(r.value for r in spark.read.text(a.specification).collect())
    if a.mode == "dump" and a.store:
        asvs = files.numbered(files.read_fasta(spark, a.asvs))
        text = a.store.endswith((".tsv", ".txt", ".gz"))
        store = select.store_of_ids(files.read_store(spark, a.store), asvs) if text else spark.read.parquet(a.store)
        kept = jobs.dump_cached(asvs, store, a.index or [], spark.read.parquet(a.hashes) if a.hashes else None)
        files.write_result_sets(kept, a.output, mode)
        return
    inputs = jobs.load(spark, a.asvs, a.readmap, a.libraries, a.taxa, a.tree, a.divergence, a.model, "clade" in text, a.keep)
    if a.mode == "dump":
        files.fasta_lines(jobs.dump_spec(inputs, a.specification or [], a.anyfail)).write.mode(mode).text(a.output)
        return
    if a.controls:
        tagged = files.read_controls(spark, a.controls)
    else:
        refs = files.read_fasta(spark, a.references).select(F.col("asv_id").alias("ref_id"), F.upper("seq").alias("ref_seq"))
        bounds = length_bounds(**_lengths(a))
        options = (bounds, a.table, a.frame, a.confidence, a.least_stops, a.least_match, a.ignore_ambiguous, a.expected, a.by_codon)
        find_them = lambda: jobs.find_controls(inputs, refs, *options)
        if a.keep:
            # which of several sequences stands for a reference depends on the counts
            stamp = {"options": options, "inputs": [resume.digest(spark, x) for x in (a.asvs, a.references, *([a.readmap] if a.readmap else sorted(a.libraries)))]}
            tagged = resume.resumed(spark, a.keep, "controls", stamp, find_them)
        else:
            tagged = find_them()
    results, scored, grid = jobs.find(inputs, tagged, text, a.anyfail)
    results = results.cache()
    results.orderBy("resultindex").write.mode(mode).csv(f"{a.output}/results", header=True)
    select.hash_store(results).orderBy("resultindex").write.mode(mode).parquet(f"{a.output}/hashes")
    tagged.select("reason", "asv_id").write.mode(mode).csv(f"{a.output}/controls", sep="\t")
    metric = f"{a.metric}_score"
    top = select.top_proportion(results, metric, a.top) if a.top else select.best_sets(results, metric)
    indices = [r.resultindex for r in select.unique_compositions(top).collect()]  # the grid's size at most
    jobs.store_of(scored, grid, indices).write.mode(mode).parquet(f"{a.output}/store")


if __name__ == "__main__":
    main()
