"""The registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seqf
from ..operators import binning, clades, controls, linkage, refmatch, select, sweep, trees
from ..specs import Spec, parse_specs, threshold_sets
from . import projection as p

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Tables of the SQL side: counts, sequences with controls, and a score per spec.
COUNTS = "SELECT l_suppkey AS library, l_partkey AS asv_id, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL"
ASVS = "SELECT p_partkey AS asv_id, p_size <= 5 AS is_target, p_size >= 46 AS is_nontarget FROM part"
_TR = "translate({}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
SEQS = f"SELECT doc_id AS asv_id, substr({_TR.format('md5(doc_id || \':0\') || md5(doc_id || \':1\')')}, 1, CAST(58 + doc_id % 7 AS INT)) AS seq FROM documents"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
REFS = f"SELECT asv_id AS ref_id, CASE WHEN asv_id % 20 = 0 THEN {_RC.format('x')} ELSE x END AS ref_seq FROM (SELECT asv_id, 'ACGTAC' || seq || 'GGTT' AS x FROM seqs WHERE asv_id % 10 = 0)"
STOPS = "({})".format(", ".join(f"'{c}'" for c in seqf.stop_codons(5)))


def _stops(frame: int) -> str:
    return f"CAST(len(list_filter(range(0, (len(seq) - {frame - 1}) // 3), lambda i: substr(seq, CAST({frame} + 3 * i AS INT), 3) IN {STOPS})) AS INT)"


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*tables: str) -> str:
    known = {"counts": COUNTS, "asvs": ASVS, "seqs": SEQS, "refs": REFS}
    return "WITH " + ", ".join(f"{t} AS ({known[t]})" for t in tables) + " "


@registered("SELECT event_type AS library, user_id AS asv_id, count(*) AS n FROM events GROUP BY ALL")
def count_reads_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers name the library (S-6, X-2), reads are counted (A-1)."""
    reads = p.table(spark, sf_dir, "events").select(F.concat(F.lit("r"), "event_id", F.lit(";sample="), "event_type", F.lit(";")).alias("header"), F.col("user_id").alias("asv_id"))
    return binning.count_reads(reads.select(seqf.library_of_header(F.col("header")).alias("library"), "asv_id"))


@registered(_with("seqs") + "SELECT d.lang AS library, s.asv_id, count(*) AS n FROM documents d JOIN seqs r ON r.asv_id = d.doc_id JOIN seqs s ON upper(r.seq) = s.seq GROUP BY ALL")
def exact_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, in lower case, matched to the sequences they equal (J-1)."""
    from ..sources.files import match_reads

    s = p.sequences(spark, sf_dir)
    reads = p.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asv_id"), F.col("lang").alias("library")).join(s, "asv_id").select("library", F.upper(F.lower("seq")).alias("seq"))
    return binning.count_reads(match_reads(reads, s))


@registered("WITH c AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL) SELECT c_custkey AS asv_id, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON c_custkey = o_custkey")
def total_counts_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all sequences, those without reads too (A-2)."""
    reads = p.table(spark, sf_dir, "orders").select(F.lit("x").alias("library"), F.col("o_custkey").alias("asv_id"))
    return binning.total_counts(binning.count_reads(reads), p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asv_id")))


NATIONS = list(range(25))


@registered("SELECT c_mktsegment AS library, " + ", ".join(f'CAST(coalesce(sum(CASE WHEN c_nationkey = {i} THEN 1 END), 0) AS BIGINT) AS "{i}"' for i in NATIONS) + " FROM customer GROUP BY ALL")
def counts_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense table of libraries by sequences (K-1)."""
    reads = p.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("library"), F.col("c_nationkey").alias("asv_id"))
    return binning.counts_matrix(binning.count_reads(reads), NATIONS)


@registered("SELECT c_mktsegment AS library, c_nationkey AS asv_id, count(*) AS n FROM customer GROUP BY ALL")
def readmap_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense table back in long form, without zeros (S-7, F-7)."""
    wide = counts_matrix_pivot(spark, sf_dir)
    return wide.unpivot(["library"], [str(i) for i in NATIONS], "asv_id", "n").filter("n > 0").select("library", F.col("asv_id").cast("int").alias("asv_id"), "n")


def _bin_query(base: str, parts: tuple[str, ...], metric: str) -> None:
    spec = Spec(base, parts, metric)
    name = "bin_" + "_".join((base, *parts, metric))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return binning.bin_values(p.counts(spark, sf_dir), p.memberships(spark, sf_dir), spec)

    query.__name__, query.__doc__ = name, f"Counts by {spec.name} (J-2, A-3, W-3)."
    cols = {"clade": "p_brand", "taxon": "p_type"}
    keys = [base, *parts]
    head = "library" if base == "library" else "'total' AS total"
    rows = f"SELECT {head}, {''.join(f'{cols[x]} AS {x}, ' for x in parts)}asv_id, {'n' if base == 'library' else 'CAST(sum(n) AS BIGINT) AS n'} FROM counts JOIN part ON p_partkey = asv_id WHERE n > 0 {'GROUP BY ALL' if base == 'total' else ''}"
    value = "CAST(n AS DOUBLE)" if metric == "n" else f"CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {', '.join(keys)}) AS DOUBLE)"
    QUERIES[name] = query
    SQL[name] = f"WITH counts AS ({COUNTS}), b AS ({rows}) SELECT *, {value} AS value FROM b"


for _args in (("library", (), "n"), ("library", (), "p"), ("total", (), "p"), ("library", ("clade",), "p"), ("library", ("taxon",), "p"), ("library", ("clade", "taxon"), "p")):
    _bin_query(*_args)

_LP = "SELECT asv_id, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY library) AS DOUBLE) AS value FROM counts WHERE n > 0"


@registered(_with("counts") + f"SELECT asv_id, max(value) AS score FROM ({_LP}) GROUP BY ALL")
def score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score under the rule that all bins must fail (A-3)."""
    return binning.scores(p.counts(spark, sf_dir), {}, Spec("library", (), "p"))


@registered(_with("counts") + f"SELECT asv_id, min(value) AS score FROM ({_LP}) GROUP BY ALL")
def score_anyfail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score under the rule that any bin may fail (Q9)."""
    return binning.scores(p.counts(spark, sf_dir), {}, Spec("library", (), "p"), anyfail=True)


def _scored(spark: SparkSession, sf_dir: str, text: str) -> tuple[DataFrame, object]:
    grid = parse_specs(text)
    groups = p.memberships(spark, sf_dir) if any(s.parts for s in grid.specs) else {}
    return binning.wide_scores(p.asvs(spark, sf_dir), p.counts(spark, sf_dir), groups, grid.specs), grid


_SCORED = _with("counts", "asvs") + (
    ", v AS (SELECT c.asv_id, p_brand, c.n, CAST(c.n AS DOUBLE) / CAST(sum(c.n) OVER (PARTITION BY library) AS DOUBLE) AS lp, CAST(c.n AS DOUBLE) / CAST(sum(c.n) OVER (PARTITION BY library, p_brand) AS DOUBLE) AS cp FROM counts c JOIN part ON p_partkey = c.asv_id WHERE c.n > 0)"
    ", s AS (SELECT asv_id, CAST(max(n) AS DOUBLE) AS ln, max(lp) AS lp, max(cp) AS cp FROM v GROUP BY ALL)"
    ", scored AS (SELECT a.asv_id, a.is_target, a.is_nontarget, ln, lp, cp FROM asvs a LEFT JOIN s ON a.asv_id = s.asv_id)"
)


@registered(_SCORED + "SELECT asv_id FROM scored WHERE ln < 50.0")
def reject_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences below the threshold in all libraries (F-5)."""
    return binning.scores(p.counts(spark, sf_dir), {}, Spec("library", (), "n")).filter("score < 50").select("asv_id")


@registered(_with("counts") + "SELECT asv_id FROM counts WHERE n > 0 GROUP BY ALL HAVING min(n) < 5")
def reject_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences below the threshold in any library (F-5, Q9)."""
    return binning.scores(p.counts(spark, sf_dir), {}, Spec("library", (), "n"), anyfail=True).filter("score < 5").select("asv_id")


@registered(_SCORED + "SELECT CAST(0 AS BIGINT) AS resultindex, asv_id FROM scored WHERE (ln < 75.0 OR lp < 0.005 OR is_nontarget) AND NOT is_target")
def reject_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual rejects of one set of two specs (F-6, U-3)."""
    scored, grid = _scored(spark, sf_dir, "[library; n; 75] * [library; p; 0.005]")
    return sweep.rejects(scored, threshold_sets(spark, grid), grid.names())


def _grid_sql(text: str) -> str:
    """All sets as SQL values, in the order of the grid."""
    from itertools import product

    grid, rows = parse_specs(text), []
    for i in range(len(grid.terms)):
        used = grid.used(i)
        for values in product(*(grid.terms[i][n] for n in used)):
            at = dict(zip(used, values, strict=True))
            rows.append(f"({len(rows)}, '{'*'.join(used)}', " + ", ".join(f"{at.get(n, 0.0)!r}::DOUBLE" for n in grid.names()) + ")")
    cols = ", ".join(f'"{n}_threshold"' for n in grid.names())
    return f"SELECT CAST(i AS BIGINT) AS resultindex, term, {cols} FROM (VALUES {', '.join(rows)}) t(i, term, {cols})"


@registered(_SCORED + f", g AS ({_grid_sql(p.ADDITIVE)}) SELECT g.*, (SELECT count(*) FROM scored WHERE ln < library_n_threshold) AS below FROM g")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All threshold sets of the additive specification, with the number of sequences whose greatest count in a library is below
    the set's (X-6, X-8, W-4)."""
    grid = parse_specs(p.ADDITIVE)
    levels = sorted({t for term in grid.terms for t in term.get("library_n", [])} | {0.0})
    own = binning.scores(p.counts(spark, sf_dir), {}, Spec("library", (), "n"))
    below = own.agg(*(F.count_if(F.col("score") < t).alias(str(i)) for i, t in enumerate(levels)))
    below = below.select(F.explode(F.array(*(F.struct(F.lit(t).alias("library_n_threshold"), F.col(str(i)).alias("below")) for i, t in enumerate(levels)))).alias("x")).select("x.*")
    return threshold_sets(spark, grid).join(F.broadcast(below), "library_n_threshold")  # a row for each level


def _sweep_sql(text: str) -> str:
    grid = parse_specs(text)
    cols = {"library_n": "ln", "library_p": "lp", "library|clade_p": "cp"}
    below = " OR ".join(f'coalesce({cols[n]} < "{n}_threshold", false)' for n in grid.names())
    own = ", ".join(f'"{n}_threshold"' for n in grid.names())
    r = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"
    parts = []
    for name, kept, of in (("asvsprelim", "kept", "total"), ("verifiedauthentic", "tp", "t"), ("verifiednonauthentic", "fp", "nt"), ("asvsactual", "(total - rejected)", "total")):
        parts += [f"{kept} AS {name}_retained_n", f"{r(kept, of)} AS {name}_retained_p", f"{of} - {kept} AS {name}_rejected_n", f"{r(f'{of} - {kept}', of)} AS {name}_rejected_p"]
    return (
        _SCORED + f", g AS ({_grid_sql(text)})"
        f", e AS (SELECT g.*, is_target, is_nontarget AND NOT is_target AS bad, ({below}) AS low FROM g CROSS JOIN scored)"
        f", m AS (SELECT resultindex, term, {own}, count(*) AS total, count(*) FILTER (NOT low) AS kept, count(*) FILTER (is_target) AS t, count(*) FILTER (bad) AS nt, count(*) FILTER (is_target AND NOT low) AS tp, count(*) FILTER (bad AND NOT low) AS fp, count(*) FILTER ((low OR bad) AND NOT is_target) AS rejected FROM e GROUP BY ALL)"
        f", r AS (SELECT resultindex, term, {own}, {r('tp + nt - fp', 't + nt')} AS accuracy_score, {r('tp', 'tp + fp')} AS precision_score, {r('tp', 't')} AS recall_score, total AS asvs_total, t AS verifiedauthentic_total_observed, nt AS verifiednonauthentic_total_observed, {', '.join(parts)} FROM m) "
    )


def _plain(results: DataFrame) -> DataFrame:
    """Without the hash, whose values only tell equal sets, and the estimates, which have a query of their own."""
    return results.drop("rejects_hash", *(c for c in results.columns if "_estimate" in c))


@registered(_sweep_sql(p.LIBRARY_P) + "SELECT * FROM r")
def sweep_library_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec, all thresholds (J-6, A-5)."""
    return _plain(sweep.sweep(*_scored(spark, sf_dir, p.LIBRARY_P)))


@registered(_sweep_sql(p.ADDITIVE) + "SELECT * FROM r")
def sweep_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three specs, one after the other (J-6, R2)."""
    return _plain(sweep.sweep(*_scored(spark, sf_dir, p.ADDITIVE)))


@registered(_sweep_sql(p.SWEEP) + "SELECT * FROM r")
def sweep_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two specs, all pairs of thresholds (J-6, R1)."""
    return _plain(sweep.sweep(*_scored(spark, sf_dir, p.SWEEP)))


@registered(_sweep_sql(p.SWEEP) + "SELECT resultindex, accuracy_score, precision_score, recall_score FROM r")
def confusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision and recall (A-6)."""
    return sweep.sweep(*_scored(spark, sf_dir, p.SWEEP)).select("resultindex", "accuracy_score", "precision_score", "recall_score")


_EST = ["authentic_total_estimate", "nonauthentic_total_estimate", "authentic_retained_estimate_n", "nonauthentic_retained_estimate_n", "authentic_retained_estimate_p", "nonauthentic_retained_estimate_p"]
_EST_SQL = (
    ", q AS (SELECT resultindex, asvs_total::DOUBLE AS n, asvsprelim_retained_n::DOUBLE AS k, CASE WHEN verifiedauthentic_total_observed > 0 THEN verifiedauthentic_retained_p END AS rt, CASE WHEN verifiednonauthentic_total_observed > 0 THEN verifiednonauthentic_retained_p END AS rn FROM r)"
    ", x AS (SELECT *, CASE WHEN rt - rn <> 0 AND k <> 0 THEN (k - n * rn) / (rt - rn) END AS a FROM q)"
    "SELECT resultindex, round(a, 6) AS authentic_total_estimate, round(n - a, 6) AS nonauthentic_total_estimate, round(a * rt, 6) AS authentic_retained_estimate_n, round(rn * (n - a), 6) AS nonauthentic_retained_estimate_n, CASE WHEN k <> 0 THEN round(a * rt / k, 6) END AS authentic_retained_estimate_p, CASE WHEN k <> 0 THEN round(rn * (n - a) / k, 6) END AS nonauthentic_retained_estimate_p FROM x"
)


@registered(_sweep_sql(p.SWEEP) + _EST_SQL)
def population_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the true populations (A-7)."""
    return sweep.sweep(*_scored(spark, sf_dir, p.SWEEP)).select("resultindex", *(F.round(c, 6).alias(c) for c in _EST))


@registered(_SCORED + "SELECT asv_id, (coalesce(lp < 0.005, false) OR is_nontarget) AND NOT is_target AS rejected FROM scored")
def actual_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects and non-targets, but no targets (U-3)."""
    scored, grid = _scored(spark, sf_dir, "[library; p; 0.005]")
    out = sweep.rejects(scored, threshold_sets(spark, grid), grid.names()).select("asv_id", F.lit(True).alias("rejected"))
    return scored.select("asv_id").join(out, "asv_id", "left").select("asv_id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


_STORE = "[library; p; 0.003,0.0045,0.006]"
_STORE_SQL = _SCORED + f", g AS ({_grid_sql(_STORE)}), o AS (SELECT resultindex, asv_id, (coalesce(lp < \"library_p_threshold\", false) OR is_nontarget) AND NOT is_target AS rejected FROM g CROSS JOIN scored) "


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, grid = _scored(spark, sf_dir, _STORE)
    out = sweep.rejects(scored, threshold_sets(spark, grid), grid.names())
    return select.encode_store(out.withColumnRenamed("asv_id", "asv_ord"), p.asvs(spark, sf_dir).select(F.col("asv_id").alias("asv_ord")))


@registered(_STORE_SQL + "SELECT resultindex, CASE WHEN count(*) FILTER (rejected) < 0.5 * count(*) THEN 'reject' ELSE 'retain' END AS action, CASE WHEN count(*) FILTER (rejected) < 0.5 * count(*) THEN count(*) FILTER (rejected) ELSE count(*) FILTER (NOT rejected) END AS ids FROM o GROUP BY ALL")
def store_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shorter of rejects and retained (U-6)."""
    return _store(spark, sf_dir).groupBy("resultindex", "action").agg(F.sum(F.bitmap_count("bits")).alias("ids"))


@registered(_STORE_SQL + "SELECT resultindex, asv_id FROM o WHERE NOT rejected")
def dump_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored sets retain (S-12, U-4)."""
    return select.retained_from_store(p.asvs(spark, sf_dir).select(F.col("asv_id").alias("asv_ord")), _store(spark, sf_dir)).withColumnRenamed("asv_ord", "asv_id")


@registered(_SCORED + "SELECT asv_id FROM scored WHERE NOT coalesce(lp < 0.005, false)")
def dump_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one specification retains, without controls (K-3)."""
    out = binning.scores(p.counts(spark, sf_dir), {}, Spec("library", (), "p")).filter("score < 0.005")
    return select.retained(p.asvs(spark, sf_dir).select("asv_id"), out)


@registered(_sweep_sql(p.SWEEP) + "SELECT resultindex, accuracy_score FROM r WHERE accuracy_score = (SELECT max(accuracy_score) FROM r)")
def best_threshold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of the highest accuracy (A-13, T-2)."""
    return select.best_sets(sweep.sweep(*_scored(spark, sf_dir, p.SWEEP))).select("resultindex", "accuracy_score")


@registered(_sweep_sql(p.SWEEP) + ", u AS (SELECT accuracy_score, row_number() OVER (ORDER BY accuracy_score DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT accuracy_score FROM r)) SELECT resultindex, accuracy_score FROM r WHERE accuracy_score >= (SELECT min(accuracy_score) FROM u WHERE k <= greatest(1, round(0.25 * n)))")
def top_proportion_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of the top quarter of distinct scores (T-3, W-5)."""
    return select.top_proportion(sweep.sweep(*_scored(spark, sf_dir, p.SWEEP)), "accuracy_score", 0.25).select("resultindex", "accuracy_score")


@registered(_SCORED + f", g AS ({_grid_sql(p.SWEEP)}), o AS (SELECT resultindex, string_agg(asv_id, ',' ORDER BY asv_id) AS ids FROM (SELECT resultindex, CASE WHEN (coalesce(ln < \"library_n_threshold\", false) OR coalesce(lp < \"library_p_threshold\", false) OR is_nontarget) AND NOT is_target THEN asv_id END AS asv_id FROM g CROSS JOIN scored) GROUP BY ALL) SELECT min(resultindex) AS resultindex, count(*) AS sets FROM o GROUP BY ids")
def unique_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with the same outcome, by the first of them (A-11, A-12, A-15)."""
    return select.unique_compositions(sweep.sweep(*_scored(spark, sf_dir, p.SWEEP)))


@registered(_with("seqs") + "SELECT asv_id FROM seqs WHERE NOT len(seq) BETWEEN 60 AND 63")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences outside the length range (F-1, F-2)."""
    return controls.length_fails(p.sequences(spark, sf_dir), *seqf.length_bounds(minimum=60, maximum=63))


@registered(_with("seqs") + "SELECT asv_id FROM seqs WHERE NOT (len(seq) BETWEEN 58 AND 64 AND abs(61 - len(seq)) % 3 = 0)")
def length_codon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences off the expected length by other than whole codons (F-1, F-3)."""
    return controls.length_fails(p.sequences(spark, sf_dir), *seqf.length_bounds(expected=61, codons=1), expected=61, by_codon=True)


@registered(_with("seqs") + f"SELECT asv_id, {', '.join(f'{_stops(f)} AS stops{f}' for f in (1, 2, 3))} FROM seqs")
def stop_counts_3frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop codons in each frame (X-5)."""
    return controls.stop_counts(p.sequences(spark, sf_dir)).select("asv_id", "stops1", "stops2", "stops3")


@registered(_with("seqs") + f"SELECT asv_id FROM seqs WHERE {_stops(2)} > 0")
def stop_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a stop in frame 2 (F-4)."""
    return controls.stop_fails(p.sequences(spark, sf_dir), 2)


@registered(_with("seqs") + f", r AS (SELECT asv_id AS asv_ord, {', '.join(f'CAST(sum({_stops(f)}) OVER w AS BIGINT) AS run_stops{f}' for f in (1, 2, 3))} FROM seqs WINDOW w AS (ORDER BY asv_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT *, run_stops1 + run_stops2 + run_stops3 AS run_total, (run_stops1 + run_stops2 + run_stops3) / 3.0::DOUBLE AS m FROM r) SELECT asv_ord, run_stops1, run_stops2, run_stops3, run_total, CASE WHEN m > 0 THEN round(1 - exp(-((run_stops1 - m) * (run_stops1 - m) / m + (run_stops2 - m) * (run_stops2 - m) / m + (run_stops3 - m) * (run_stops3 - m) / m) / 2), 9) END AS confidence FROM t")
def frame_detection_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops by frame after each sequence, and how surely they are uneven (W-1, X-11)."""
    return controls.frame_prefixes(p.sequences(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


_HITS = _with("seqs", "refs") + f", hits AS (SELECT DISTINCT asv_id, ref_id FROM seqs JOIN refs ON strpos(ref_seq, seq) > 0 OR strpos({_RC.format('ref_seq')}, seq) > 0 WHERE len(seq) >= 50)"
_TOTALS = ", totals AS (SELECT doc_id AS asv_id, n_chars AS n FROM documents)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refmatch.reference_hits(p.sequences(spark, sf_dir), p.references(spark, sf_dir), 50)


@registered(_HITS + " SELECT asv_id, ref_id FROM hits")
def refmatch_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that stand in a reference, on either strand (J-4, H-2)."""
    return _hits(spark, sf_dir)


#: Every tenth sequence as a reference: with N inside, its start cut off, or its end; of each shift at which both overlap enough.
_SEMI = (
    _with("seqs")
    + "SELECT DISTINCT asv_id, ref_id FROM (SELECT s.asv_id, r.asv_id AS ref_id, s.seq, r.x AS x, unnest(range(46 - len(s.seq), len(r.x) - 45)) AS o"
    " FROM seqs s, (SELECT asv_id, CASE asv_id % 3 WHEN 0 THEN substr(seq, 1, 20) || 'NNN' || substr(seq, 24, 100) WHEN 1 THEN substr(seq, 9, 100) || 'ACG' ELSE substr(seq, 1, len(seq) - 8) END AS x FROM seqs WHERE asv_id % 10 = 0) r)"
    " WHERE least(len(seq), len(x) - o) - greatest(0, -o) >= 46 AND regexp_matches(substr(seq, greatest(0, -o) + 1, least(len(seq), len(x) - o) - greatest(0, -o)),"
    " '^' || replace(substr(x, greatest(0, o) + 1, least(len(seq), len(x) - o) - greatest(0, -o)), 'N', '.') || '$')"
)


@registered(_SEMI)
def refmatch_semiperfect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that match references with N, or hang over their ends (H-2)."""
    s = p.sequences(spark, sf_dir)
    part = lambda i, n=100: F.substring("seq", i, n)
    x = F.when(F.col("asv_id") % 3 == 0, F.concat(part(1, 20), F.lit("NNN"), part(24))).when(F.col("asv_id") % 3 == 1, F.concat(part(9), F.lit("ACG"))).otherwise(F.expr("substring(seq, 1, length(seq) - 8)"))
    return refmatch.reference_hits(s, s.filter("asv_id % 10 = 0").select(F.col("asv_id").alias("ref_id"), x.alias("ref_seq")), 46)


_ALL = ", many AS (SELECT asv_id, ref_id // 100 AS ref_id FROM hits)"


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in groups, so that several sequences match one."""
    return _hits(spark, sf_dir).select("asv_id", F.floor(F.col("ref_id") / 100).cast("long").alias("ref_id"))


@registered(_HITS + _TOTALS + _ALL + ", k AS (SELECT ref_id, many.asv_id, row_number() OVER (PARTITION BY ref_id ORDER BY n DESC, many.asv_id) AS r FROM many JOIN totals ON totals.asv_id = many.asv_id) SELECT ref_id, asv_id FROM k WHERE r = 1")
def refmatch_ambig_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sequences that match a reference the most abundant (A-10, W-2)."""
    return controls.resolve_ambiguous(_many(spark, sf_dir), p.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asv_id"), F.col("n_chars").alias("n")))


@registered(_HITS + " SELECT ref_id, min(asv_id) AS asv_id FROM hits GROUP BY ref_id HAVING count(*) = 1")
def refmatch_ignore_ambig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only references that one sequence matches (A-10)."""
    return controls.resolve_ambiguous(_hits(spark, sf_dir), p.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asv_id"), F.col("n_chars").alias("n")), ignore=True)


@registered(_HITS + f", l AS (SELECT asv_id FROM seqs WHERE NOT len(seq) BETWEEN 59 AND 64), s AS (SELECT asv_id FROM seqs WHERE {_stops(2)} > 0) SELECT asv_id, 'lengthfail' AS reason FROM l UNION ALL SELECT asv_id, 'stopfail' FROM s UNION ALL (SELECT DISTINCT asv_id, 'refpass' FROM hits WHERE asv_id NOT IN (SELECT asv_id FROM l) AND asv_id NOT IN (SELECT asv_id FROM s))")
def control_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who failed, and who matched without failing (U-1, U-2, K-5)."""
    s = p.sequences(spark, sf_dir)
    return controls.control_list(controls.length_fails(s, 59, 64), controls.stop_fails(s, 2), _hits(spark, sf_dir))


@registered(_with("counts") + ", s AS (SELECT library, count(*) AS n_asvs FROM counts WHERE n > 0 GROUP BY ALL) SELECT n_asvs, count(*) AS libraries FROM s GROUP BY ALL")
def library_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries by their number of sequences (A-8)."""
    return binning.library_size_histogram(p.counts(spark, sf_dir))


@registered(_with("seqs") + ", c AS (SELECT b AS base, CAST(sum(len(seq) - len(replace(seq, b, ''))) AS BIGINT) AS n FROM seqs CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) t(b) GROUP BY ALL) SELECT base, n, n::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE AS frequency FROM c")
def base_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the bases (A-16)."""
    return clades.base_frequencies(p.sequences(spark, sf_dir))


_MD = "substr({0}, 1, CAST(s_suppkey % 60 AS INT)) || {1} || substr({0}, CAST(s_suppkey % 60 + 5 AS INT), 64)".format(_TR.format("md5(s_nationkey::VARCHAR) || md5(s_nationkey || ':1')"), _TR.format("substr(md5(s_suppkey::VARCHAR), 1, 4)"))
_F84 = (
    f"WITH q AS (SELECT s_suppkey AS k, {_MD} AS seq FROM supplier), f AS (SELECT {', '.join(f'sum(len(seq) - len(replace(seq, {b!r}, {str()!r})))::DOUBLE / sum(len(seq))::DOUBLE AS {b.lower()}' for b in 'ACGT')} FROM q)"
    ", w AS (SELECT (c * t / (c + t) + a * g / (a + g)) AS ka, c * t + a * g AS kb, (a + g) * (c + t) AS kc FROM f)"
    ", z AS (SELECT k, list_transform(range(1, 65), lambda i: substr(seq, CAST(i AS INT), 1)) AS l, list_transform(range(1, 65), lambda i: substr(translate(seq, 'ACGT', 'RYRY'), CAST(i AS INT), 1)) AS y FROM q)"
    ", d AS (SELECT x.k AS a, v.k AS b, len(list_filter(range(1, 65), lambda i: x.l[i] <> v.l[i])) / 64.0::DOUBLE AS pd, len(list_filter(range(1, 65), lambda i: x.y[i] <> v.y[i])) / 64.0::DOUBLE AS tv FROM z x JOIN z v ON x.k < v.k)"
    ", e AS (SELECT a, b, pd - tv AS ts, tv, ka, kb, kc, 1 - (pd - tv) / (2 * ka) - (ka - kb) * tv / (2 * ka * kc) AS m1, 1 - tv / (2 * kc) AS m2 FROM d CROSS JOIN w)"
    "SELECT a, b, CASE WHEN m1 > 0 AND m2 > 0 THEN round(-2 * ka * ln(m1) + 2 * (ka - kb - kc) * ln(m2), 7) END AS d FROM e"
)


@registered(_F84)
def pairwise_f84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F84 distances of all pairs of aligned sequences (X-12, J-7)."""
    return clades.distances(p.aligned(spark, sf_dir), digits=7).select("a", "b", F.when(~F.isnan("d"), F.col("d")).alias("d"))


_KINDS = {"ag": "('AG', 'GA')", "ct": "('CT', 'TC')", "tv1": "('AT', 'TA', 'CG', 'GC')", "tv2": "('AC', 'CA', 'GT', 'TG')"}
_MODELS = (
    _F84[: _F84.index(", w AS")]
    + ", z AS (SELECT k, list_transform(range(1, 65), lambda i: substr(seq, CAST(i AS INT), 1)) AS l FROM q)"
    + f", n AS (SELECT x.k AS a, v.k AS b, {', '.join(f'len(list_filter(range(1, 65), lambda i: (x.l[i] || v.l[i]) IN {v})) AS {k}' for k, v in _KINDS.items())} FROM z x JOIN z v ON x.k < v.k)"
    + ", e AS (SELECT n.a AS x, n.b AS v, (ag + ct)::DOUBLE AS nts, (tv1 + tv2)::DOUBLE AS ntv, ag / 64.0::DOUBLE AS p1, ct / 64.0::DOUBLE AS p2, (ag + ct) / 64.0::DOUBLE AS ts, tv1 / 64.0::DOUBLE AS q1, tv2 / 64.0::DOUBLE AS q2, (tv1 + tv2) / 64.0::DOUBLE AS tv, 1 - f.a*f.a - f.c*f.c - f.g*f.g - f.t*f.t AS m, f.a + f.g AS r, f.c + f.t AS y, 2 * (f.g + f.c) * (1 - f.g - f.c) AS w, 2 * f.a * f.g / (f.a + f.g) AS kr, 2 * f.c * f.t / (f.c + f.t) AS ky, f.a * f.g AS rr, f.c * f.t AS yy FROM n CROSS JOIN f)"
    + ", o AS (SELECT *, 1 - (ts + tv) / m AS f1, 1 - 2 * ts - 2 * q1 AS k1, 1 - 2 * ts - 2 * q2 AS k2, 1 - 2 * tv AS k3, 1 - ts / w - tv AS t1, 1 - p1 / kr - tv / (2 * r) AS n1, 1 - p2 / ky - tv / (2 * y) AS n2, 1 - tv / (2 * r * y) AS n3, 2 * (r * y - rr * y / r - yy * r / y) AS kv FROM e)"
    + 'SELECT x AS a, v AS b, nts + ntv AS "N", nts AS "TS", ntv AS "TV", CASE WHEN f1 > 0 THEN round(-m * ln(f1) + 0.0, 6) END AS "F81", CASE WHEN k1 > 0 AND k2 > 0 AND k3 > 0 THEN round(-0.25 * (ln(k1) + ln(k2) + ln(k3)) + 0.0, 6) END AS "K81", CASE WHEN t1 > 0 AND k3 > 0 THEN round(-w * ln(t1) - 0.5 * (1 - w) * ln(k3) + 0.0, 6) END AS "T92", CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN round(-kr * ln(n1) - ky * ln(n2) - kv * ln(n3) + 0.0, 6) END AS "TN93" FROM o'
)


@registered(_MODELS)
def pairwise_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of differing sites and four more distance models, all pairs (X-12)."""
    models = ("N", "TS", "TV", "F81", "K81", "T92", "TN93")
    rows = clades.distances(p.aligned(spark, sf_dir), models, digits=6)
    return rows.select("a", "b", *(F.when(~F.isnan(m), F.col(m)).alias(m) for m in models))


def _determinant() -> str:
    """Of a table c00 to c33, the sum over all orders of the columns."""
    terms = []
    for order in permutations(range(4)):
        odd = sum(order[i] > order[j] for i in range(4) for j in range(i + 1, 4)) % 2
        terms.append(("-" if odd else "+") + "*".join(f"c{i}{k}" for i, k in enumerate(order)))
    return "".join(terms)


_CELLS = [(i, j, a + b) for i, a in enumerate("ACGT") for j, b in enumerate("ACGT")]
_SITES = ", ".join(f"len(list_filter(range(1, 65), lambda i: x.l[i] || v.l[i] = '{pair}'))::BIGINT AS c{i}{j}" for i, j, pair in _CELLS)
_FIRST, _SECOND = ("*".join("(" + "+".join(f"c{i}{j}" for i, j, _ in _CELLS if (i, j)[side] == k) + ")" for k in range(4)) for side in (0, 1))
_TABLES = (
    f"WITH q AS (SELECT s_suppkey AS k, {_MD} AS seq FROM supplier), z AS (SELECT k, list_transform(range(1, 65), lambda i: substr(seq, CAST(i AS INT), 1)) AS l FROM q)"
    f", n AS (SELECT x.k AS a, v.k AS b, {_SITES} FROM z x JOIN z v ON x.k < v.k), e AS (SELECT a, b, {_determinant()} AS det, {_FIRST} AS r, {_SECOND} AS c FROM n)"
    " SELECT a, b, CASE WHEN det > 0 THEN round(-ln(det / 16777216.0::DOUBLE) / 4 - ln(4.0::DOUBLE) + 0.0, 6) END AS logdet, CASE WHEN det > 0 THEN round(-ln(det / sqrt(r::DOUBLE * c::DOUBLE)) / 4 + 0.0, 6) END AS paralin,"
    ' CASE WHEN det > 0 THEN round(-ln(det / r::DOUBLE) / 4 + 0.0, 6) END AS "BH87" FROM e'
)


@registered(_TABLES)
def pairwise_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each pair's table of bases by bases (X-12)."""
    models = ("logdet", "paralin", "BH87")
    rows = clades.distances(p.aligned(spark, sf_dir), models, digits=6)
    return rows.select("a", "b", *(F.when(~F.isnan(m), F.col(m)).alias(m) for m in models))


#: Sequences with two runs of gaps, of lengths and at places that differ.
_GAPPED = "left(left(seq, CAST(10 + {0} % 7 AS INT)) || repeat('-', CAST(1 + {0} % 5 AS INT)) || substr(seq, CAST(12 + {0} % 7 + {0} % 5 AS INT), 25) || repeat('-', CAST({0} % 3 AS INT)) || repeat('A', 64), 64)"
_GAPS = (
    f"WITH q AS (SELECT k, {_GAPPED.format('k')} AS seq FROM (SELECT s_suppkey AS k, {_MD} AS seq FROM supplier)), z AS (SELECT k, list_transform(range(1, 65), lambda i: substr(seq, CAST(i AS INT), 1) = '-') AS l FROM q)"
    ", r AS (SELECT k, l, list_transform(list_filter(range(1, 65), lambda i: l[i] AND (i = 1 OR NOT l[i - 1])), lambda i: i * 100 + coalesce(list_filter(range(1, 65), lambda j: j > i AND NOT l[j])[1], 65)) AS runs FROM z)"
    " SELECT x.k AS a, v.k AS b, len(list_filter(range(1, 65), lambda i: x.l[i] <> v.l[i]))::DOUBLE AS indel, (len(x.runs) + len(v.runs) - 2 * len(list_intersect(x.runs, v.runs)))::DOUBLE AS indelblock FROM r x JOIN r v ON x.k < v.k"
)


@registered(_GAPS)
def pairwise_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and runs of gaps that only one of a pair has (X-12)."""
    return clades.distances(p.aligned(spark, sf_dir).select("asv_ord", F.expr(_GAPPED.format("asv_ord")).alias("seq")), ("indel", "indelblock"))


@registered("WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT count(*) AS groups, min(n) AS smallest, max(n) AS largest FROM s")
def clade_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clades there are, and their least and greatest size (A-17)."""
    return clades.cluster_sizes(p.memberships(spark, sf_dir)["clade"])


@registered(_with("seqs") + "SELECT 'r' || asv_id || ' x' AS header, lower(seq) AS seq FROM seqs")
def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ and read again in splits (S-5)."""
    from ..sources.files import read_fastq

    s = p.sequences(spark, sf_dir)
    path = p.folder(spark, "reads")
    record = F.concat(F.lit("@r"), F.col("asv_id").cast("string"), F.lit(" x\n"), F.lower("seq"), F.lit("\n+\n@"), F.repeat(F.lit("I"), F.length("seq") - 1))
    s.select(record.alias("value")).write.text(path)
    return read_fastq(spark, path).select("header", "seq")


@registered("SELECT c_mktsegment AS library, c_nationkey::VARCHAR AS asv_id, count(*) AS n FROM customer GROUP BY ALL")
def count_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense table written as text, read and unpivoted (S-7)."""
    from ..sources.files import read_counts

    path = p.folder(spark, "table")
    wide = counts_matrix_pivot(spark, sf_dir)
    head = spark.createDataFrame([("library\t" + "\t".join(map(str, NATIONS)),)], "value string")
    lines = wide.select(F.concat_ws("\t", "library", *(F.col(f"`{i}`").cast("string") for i in NATIONS)).alias("value"))
    head.withColumn("o", F.lit(0)).union(lines.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    names = p.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("asv_id"))
    return read_counts(spark, path, names.withColumn("asv_key", F.col("asv_id")))


@registered()
def sweep_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """27,000 threshold sets in one sweep (J-6, A-5, A-6); too many for SQL to compare each with each sequence."""
    return sweep.sweep(*_scored(spark, sf_dir, p.WIDE)).select("resultindex", "term", "accuracy_score", "asvsprelim_retained_n", "rejects_hash")


#: Suppliers of a nation are a family: at most 8 of 64 bases differ, where between families three quarters do.
_FAMILIES = "SELECT s_suppkey AS asv_ord, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS clade FROM supplier"


@registered(_FAMILIES)
def tree_cut_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters at distance 0.2 (H-3 to H-5, R3)."""
    return linkage.linkage(p.aligned(spark, sf_dir), 0.2)[0]


@registered(_FAMILIES)
def tree_from_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree, written as Newick text, read again and cut (K-6, S-9, H-4)."""
    rows = p.aligned(spark, sf_dir)
    _, merges = linkage.linkage(rows, float("inf"))
    path = p.folder(spark, "tree")
    trees.newick_lines(trees.tree_of(merges, rows.select("asv_ord", F.col("asv_ord").cast("string").alias("name")))).write.text(path)
    tips = trees.cut(trees.read_tree(spark, path), 0.2).select(F.col("name").cast("long").alias("asv_ord"), "clade")
    return tips.join(tips.groupBy("clade").agg(F.min("asv_ord").alias("first")), "clade").select("asv_ord", F.col("first").alias("clade"))


_SINGLE = [n for n in parse_specs(p.ADDITIVE).names()]
_STATS = [f"{a}_{b}_{c}" for a in ("asvsprelim", "verifiedauthentic", "verifiednonauthentic", "asvsactual") for b in ("retained", "rejected") for c in ("n", "p")]


@registered(_sweep_sql(p.ADDITIVE) + "".join([", l AS (SELECT resultindex, term, CASE term ", *(f"WHEN '{n}' THEN \"{n}_threshold\" " for n in _SINGLE), "END AS threshold, ", ", ".join(f"{s}::DOUBLE AS {s}" for s in _STATS), " FROM r) UNPIVOT l ON ", ", ".join(_STATS), " INTO NAME stat VALUE value"]))
def analysis_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of single-spec sets in long form (X-14, J-8, F-12)."""
    return select.long_stats(sweep_additive(spark, sf_dir), _SINGLE)


@registered(_sweep_sql(p.ADDITIVE) + "SELECT resultindex, term, precision_score, CASE term WHEN 'library_n' THEN 'reads by library' WHEN 'library_p' THEN 'share by library' END AS description FROM r WHERE verifiednonauthentic_retained_p <= 0.9 AND verifiedauthentic_rejected_p <= 0.9 AND precision_score = (SELECT max(precision_score) FROM r WHERE verifiednonauthentic_retained_p <= 0.9 AND verifiedauthentic_rejected_p <= 0.9)")
def analysis_best_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the sets within error rates, with a description (F-11, T-6, J-9)."""
    rows = select.best_sets(select.within_rates(sweep_additive(spark, sf_dir), 0.9, 0.9), "precision_score")
    return select.describe_terms(rows, {"library_n": "reads by library", "library_p": "share by library"}).select("resultindex", "term", "precision_score", "description")


@registered(_with("counts", "asvs") + """, c AS (SELECT library, asv_id, n, n::DOUBLE / sum(n) OVER (PARTITION BY library) AS p FROM counts),
    b AS (SELECT library, p_brand, asv_id, n::DOUBLE / sum(n) OVER (PARTITION BY library, p_brand) AS p FROM counts JOIN part ON asv_id = p_partkey),
    x AS (SELECT asv_id, max(n)::DOUBLE AS score_n, max(p) AS score_p FROM c GROUP BY 1), y AS (SELECT asv_id, max(p) AS score_clade FROM b GROUP BY 1)
    SELECT asv_id, score_n, score_p, score_clade FROM x LEFT JOIN y USING (asv_id)""")
def running_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a stream of files; scores follow each batch, so that the last ones are those of all counts (§2.11)."""
    from ..specs import Spec
    from ..streaming.counts import dealt_files
    from ..streaming.scores import RunningScores

    rows = p.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("library"), F.col("l_partkey").alias("asv_id"), F.col("l_quantity").cast("long").alias("n"))
    path = p.folder(spark, "arriving")
    each = dealt_files(rows, path, 3)
    specs = [Spec("library", (), "n"), Spec("library", (), "p"), Spec("library", ("clade",), "p")]
    running = RunningScores(spark, p.folder(spark, "running"), p.memberships(spark, sf_dir), specs, slots=8, every=2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)
    query = stream.writeStream.foreachBatch(running.absorb).option("checkpointLocation", p.folder(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return running.scores().withColumnsRenamed(dict(zip((s.name for s in specs), ("score_n", "score_p", "score_clade"), strict=True)))
