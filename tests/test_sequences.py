import random

import pytest
from pyspark.sql import functions as F

from seqsieve.functions import sequence as s
from seqsieve.operators import controls, refmatch


def test_stop_codons():
    assert {"TAA", "TAG", "TAR"} <= set(s.stop_codons(5)) and "TGA" not in s.stop_codons(5)
    assert "TRA" in s.stop_codons(1) and "TRA" not in s.stop_codons(5)
    with pytest.raises(ValueError):
        s.stop_codons(99)


def naive_stops(seq, frame, stops):
    return sum(seq[i : i + 3] in stops for i in range(frame - 1, len(seq) - 2, 3))


def test_stop_counts(spark):
    seqs = ["", "T", "TA", "TAA", "TAAT", "ATAGTAA", "CCTAATAGTAR", "TARTARTAR", "ACGTAATAGCTAGGATAA", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(seqs)], "asv_id long, seq string")
    rows = controls.stop_counts(df).orderBy("asv_id").collect()
    for r in rows:
        if r.seq is not None:
            assert (r.stops1, r.stops2, r.stops3) == tuple(naive_stops(r.seq, f, s.stop_codons(5)) for f in (1, 2, 3)), r.seq


def test_lengths(spark):
    assert s.length_bounds(expected=100, percent=2.5) == (98, 102) and s.length_bounds(expected=418) == (418, 418)
    assert s.length_bounds(expected=10, codons=2) == (4, 16) and s.length_bounds(minimum=3) == (3, None)
    for bad in ({}, {"expected": 5, "bases": 1, "codons": 1}, {"minimum": 1, "bases": 2}, {"minimum": 5, "maximum": 1}):
        with pytest.raises(ValueError):
            s.length_bounds(**bad)
    df = spark.createDataFrame([(i, "A" * i) for i in range(8)], "asv_id long, seq string")
    assert [r.asv_id for r in controls.length_fails(df, 2, 7, expected=4, by_codon=True).orderBy("asv_id").collect()] == [0, 1, 2, 3, 5, 6]


def test_names(spark):
    row = spark.range(1).select(s.plain_name(F.lit("u1;size=5")), s.library_of_header(F.lit("r1;sample=T4;x")), s.library_of_header(F.lit("r1;barcodelabel=T-5;")), s.library_of_header(F.lit("r1")), s.base_name(F.lit("/a/b/T6.fastq")), s.reverse_complement(F.lit("AACGTN")), s.degapped(F.lit("a-c-"))).first()
    assert tuple(row) == ("u1", "T4", "T-5", "", "T6", "NACGTT", "AC")


def test_frame_detection(spark):
    # stops in frames 1 and 3 only; the first sequence alone has too few
    df = spark.createDataFrame([(i, i, "TAAATAGCC" * (1 + 3 * i)) for i in range(5)], "asv_ord long, asv_id long, seq string")
    found = controls.detect_frame(df, least_stops=20).collect()
    runs = controls.frame_prefixes(df).orderBy("asv_ord").collect()
    first = next(r for r in runs if r.run_total >= 20 and r.confidence >= 0.95)
    counts = [first.run_stops1, first.run_stops2, first.run_stops3]
    assert [(r.asv_ord, r.frame) for r in found] == [(first.asv_ord, 1 + counts.index(min(counts)))]
    assert controls.detect_frame(df, least_stops=10**6).count() == 0
    with pytest.raises(ValueError):
        controls.detect_frame(df, confidence=1)


def test_running_sums_over_groups(spark):
    from seqsieve.operators.prefix import running_sums

    df = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = running_sums(df, "k", ["v"], group=3).orderBy("k").collect()
    assert [r.run_v for r in rows] == [k * (k + 1) for k in range(20)]


def test_references(spark):
    asvs = spark.createDataFrame([("a", "ACGTTTGA"), ("b", "TCAAACGT"), ("c", "GGGGGGGG"), ("d", "ACG")], "asv_id string, seq string")
    refs = spark.createDataFrame([("r1", "TTACGTTTGACC"), ("r2", "ACGTTTGA"), ("r3", "ACGTT")], "ref_id string, ref_seq string")
    hits = refmatch.reference_hits(asvs, refs, 6)
    assert {tuple(r) for r in hits.collect()} == {(a, r) for a in "ab" for r in ("r1", "r2")}
    assert {tuple(r) for r in refmatch.reference_hits(asvs, refs, 5).collect()} == {(a, r) for a in "ab" for r in ("r1", "r2", "r3")}  # over the end
    totals = spark.createDataFrame([("a", 5), ("b", 7)], "asv_id string, n long")
    assert {tuple(r) for r in controls.resolve_ambiguous(hits, totals).collect()} == {("r1", "b"), ("r2", "b")}
    assert controls.resolve_ambiguous(hits, totals, ignore=True).count() == 0
    same = totals.withColumn("n", F.lit(0).cast("long"))
    assert {r.asv_id for r in controls.resolve_ambiguous(hits, same).collect()} == {"a"}


def test_control_list(spark):
    d = lambda *x: spark.createDataFrame([(i,) for i in x], "asv_id string")
    tags = controls.control_list(d("a"), d("a", "b"), d("b", "c"))
    assert {tuple(r) for r in tags.collect()} == {("a", "lengthfail"), ("a", "stopfail"), ("b", "stopfail"), ("c", "refpass")}
    flagged = {r.asv_id: (r.is_target, r.is_nontarget) for r in controls.with_controls(d("a", "c", "z"), tags).collect()}
    assert flagged == {"a": (False, True), "c": (True, False), "z": (False, False)}
    with pytest.raises(controls.ControlSetError):
        controls.require_controls(controls.with_controls(d("z"), tags))


def brute_hits(asvs, refs, least):
    """Every sequence on every reference at every shift."""
    turn = str.maketrans("ACGTN", "TGCAN")
    out = set()
    for a, q in asvs:
        for r, x in refs:
            for ref in (x, x.translate(turn)[::-1]):
                for shift in range(least - len(q), len(ref) - least + 1):
                    own, other = q[max(0, -shift) :], ref[max(0, shift) :]
                    n = min(len(own), len(other))
                    if n >= least and all(c in ("N", b) for b, c in zip(own[:n], other[:n], strict=True)):
                        out.add((a, r))
    return out


@pytest.mark.parametrize("least", [6, 20])
def test_semiperfect(spark, least):
    rnd = random.Random(6)
    base = ["".join(rnd.choices("ACGT", k=60)) for _ in range(3)] + ["A" * 60, "ACAC" * 15]
    asvs, refs = [], []
    for i in range(30):
        b = base[i % 5]
        at = rnd.randrange(20)
        asvs.append((f"a{i}", b[at : at + rnd.randint(15, 40)]))
        r = list(b[rnd.randrange(15) : rnd.randint(30, 60)])
        for k in rnd.sample(range(len(r)), [0, 0, 1, 3, 12][i % 5 - i // 15]):
            r[k] = "N" if i % 2 else rnd.choice("ACGTN")
        x = "".join(r)
        refs.append((f"r{i}", x if i % 3 else x.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]))
    refs += [("n", "N" * 30), ("cut", base[0][:25]), ("none", None), ("short", "ACG")]
    left = spark.createDataFrame([*asvs, ("null", None), asvs[0]], "asv_id string, seq string").repartition(3)
    right = spark.createDataFrame(refs, "ref_id string, ref_seq string")
    hits = refmatch.reference_hits(left, right, least).collect()
    assert len(hits) == len(set(hits)) and set(map(tuple, hits)) == brute_hits(asvs, [r for r in refs if r[1]], least)
    assert refmatch.reference_hits(left.filter("false"), right, least).collect() == []


def test_references_with_n_are_looked_up(spark):
    """A run of N in the middle leaves room for shorter windows: such references needn't be compared with all sequences."""
    rnd = random.Random(11)
    asvs = [(f"a{i}", "".join(rnd.choices("ACGT", k=58 + i % 7))) for i in range(60)]
    refs = [(f"r{i}", s[:20] + "NNN" + s[23:]) for i, (_, s) in enumerate(asvs) if i % 3 == 0]
    left, right = spark.createDataFrame(asvs, "asv_id string, seq string"), spark.createDataFrame(refs, "ref_id string, ref_seq string")
    rooms = right.select(refmatch._clean_run(F.col("ref_seq"), 46).alias("room")).collect()
    assert all(refmatch.LEAST_WINDOW <= r.room == 23 for r in rooms)
    assert {tuple(r) for r in refmatch.reference_hits(left, right, 46).collect()} == brute_hits(asvs, refs, 46)
