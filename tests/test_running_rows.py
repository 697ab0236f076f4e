"""What a batch writes to the logs of running scores."""

from pyspark.sql import functions as F

from seqsieve.specs import Spec
from seqsieve.streaming.scores import RunningScores


def test_a_batch_writes_no_share_of_each_member(spark, tmp_path):
    """Totals change the shares of all members of their bins; these are worked out where scores are, and not kept."""
    path = str(tmp_path / "running")
    running = RunningScores(spark, path, {}, [Spec("library", (), "n"), Spec("library", (), "p")], slots=2, every=4)
    frame = lambda rows: spark.createDataFrame(rows, "library string, asv_id string, n long")
    running.absorb(frame([(f"l{i}", f"s{j}", 1 + (i + j) % 3) for i in range(10) for j in range(40)]), 0)
    running.absorb(frame([(f"l{i}", "s0", 10) for i in range(10)]), 1)
    written = sum(spark.read.parquet(str(x)).count() for x in (tmp_path / "running").glob("*/part=d1"))
    assert 40 <= written < 100
    n = lambda i, j: 1 + (i + j) % 3 + 10 * (j == 0)
    totals = [sum(n(i, j) for j in range(40)) for i in range(10)]
    want = {f"s{j}": (float(max(n(i, j) for i in range(10))), max(n(i, j) / totals[i] for i in range(10))) for j in range(40)}
    assert {r[0]: tuple(r)[1:] for r in running.scores().select("asv_id", F.col("`library_n`"), F.col("`library_p`")).collect()} == want


def test_a_batch_of_few_bins_changes_their_members_alone(spark, tmp_path):
    running = RunningScores(spark, str(tmp_path / "running"), {}, [Spec("library", (), "p")], slots=3, every=2)
    frame = lambda rows: spark.createDataFrame(rows, "library string, asv_id string, n long")
    batches = [[(f"l{i}", f"s{(3 * i + j) % 30}", 1 + j) for i in range(10) for j in range(5)], [("l4", "s13", 8)], [], [("l9", "s29", 3), ("l0", "s40", 1)]]
    counts, totals = {}, {}
    for nth, batch in enumerate(batches):
        running.absorb(frame(batch), nth)
        for library, asv, n in batch:
            counts[library, asv] = counts.get((library, asv), 0) + n
            totals[library] = totals.get(library, 0) + n
        want = {asv: max(n / totals[k] for (k, x), n in counts.items() if x == asv) for _, asv in counts}
        assert dict(map(tuple, running.scores().select("asv_id", F.col("`library_p`")).collect())) == want
        changed = {asv for k, asv in counts if k in {b[0] for b in batch}}
        assert spark.read.schema("asv_id string").parquet(str(tmp_path / "running" / "scores-0" / f"part=d{nth}")).count() == len(changed)
