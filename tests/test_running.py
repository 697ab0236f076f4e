"""Scores that follow batches equal those of all counts."""

import random

import pytest
from pyspark.sql import functions as F

from seqsieve.operators.binning import wide_scores
from seqsieve.specs import Spec
from seqsieve.streaming.counts import dealt_files
from seqsieve.streaming.scores import RunningScores

SPECS = [Spec("library", (), "n"), Spec("library", ("clade",), "p"), Spec("total", (), "p")]


@pytest.mark.parametrize("anyfail", [False, True])
def test_scores_follow_batches(spark, tmp_path, anyfail):
    rnd = random.Random(7)
    ids = [f"s{i}" for i in range(12)]
    # s0 is in two clades, s11 in none; one library has most reads
    clades = spark.createDataFrame([("c0", "s0"), *((f"c{i % 3}", f"s{i}") for i in range(1, 11)), ("c1", "s0")], "group_id string, asv_id string")
    batches = [[(rnd.choice("AAAB"), rnd.choice(ids[: 3 + 3 * k]), rnd.randint(1, 9)) for _ in range(8)] for k in range(4)]
    batches[2] = [(None, "s1", 3), ("A", None, 4), ("A", "s2", 0)]  # nothing that counts
    batches[3].append(("C", "s11", 2))
    frame = lambda rows: spark.createDataFrame(rows, "library string, asv_id string, n long")
    path, so_far = str(tmp_path / "running"), []
    running = RunningScores(spark, path, {"clade": clades}, SPECS, anyfail, slots=3, every=2)
    with pytest.raises(ValueError, match="no batch"):
        running.scores()
    for nth, batch in enumerate(batches):
        if nth == 3:  # in a new session
            running = RunningScores(spark, path, {"clade": clades}, SPECS, anyfail, slots=3, every=2)
        running.absorb(frame(batch), nth)
        if nth == 2:
            running.absorb(frame(batch), nth)  # repeated
        so_far += batch
        summed = frame(so_far).filter("n > 0 and library is not null and asv_id is not null").groupBy("library", "asv_id").sum("n").withColumnRenamed("sum(n)", "n")
        want = wide_scores(summed.select("asv_id").distinct(), summed, {"clade": clades}, SPECS, anyfail)
        if nth in (0, 2, 3):
            got = {r[0]: tuple(r)[1:] for r in running.scores().select("asv_id", *(f"`{s.name}`" for s in SPECS)).collect()}
            assert got == {r[0]: tuple(r)[1:] for r in want.select("asv_id", *(f"`{s.name}`" for s in SPECS)).collect()}


@pytest.mark.parametrize(("n", "files", "each"), [(1000, 20, 7), (90, 3, 1)])
def test_batches_are_dealt_over_files(spark, tmp_path, n, files, each):
    """More rows make more files of a batch, not larger ones."""
    path = str(tmp_path / "arriving")
    assert dealt_files(spark.range(n), path, 3, most=50) == each
    rows = spark.read.parquet(path)
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == files and sum(sizes) == n and max(sizes) <= 60
    assert sorted(r.id for r in rows.collect()) == list(range(n))
