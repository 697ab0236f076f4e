"""Scores kept up to date as counts arrive (§2.11): each batch changes the bins it touches and the sequences in them, no other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import binned
from ..specs import Spec


class Log:
    """A table that batches add rows to. Rows are kept by slot, a hash of some columns, so that those of a few keys are found in a
    few folders; every some batches all that came before is folded into one. The folders of a batch are told by its number, and a
    batch that is repeated writes them again, so that nothing is counted twice."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], fold: Callable[[DataFrame], DataFrame], slots: int, every: int):
        self.spark, self.path, self.by, self.fold, self.slots, self.every = spark, path, by, fold, slots, every
        self.schema = None

    def _slot(self, keys: DataFrame):
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in self.by)), F.lit(self.slots)).cast("int").alias("slot")

    def _write(self, rows: DataFrame, part: str) -> None:
        # small slots are written by one task each, large ones (one bin may hold most rows) are split
        rows.select("*", self._slot(rows)).hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/part={part}")

    def _drop(self, part: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={part}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def rows(self, before: int, of: DataFrame | None = None, folded: bool = True) -> DataFrame:
        """The rows of the batches before the given one, folded; with `of` those only whose `by` columns are one of its rows'."""
        whole = max(0, before - 1) // self.every * self.every
        parts = [f"w{whole}"] * (whole > 0) + [f"d{i}" for i in range(whole, before)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(f"{self.schema.toDDL()}, part string, slot int").option("basePath", self.path)
        rows = read.parquet(*(f"{self.path}/part={x}" for x in parts))
        if of is not None:
            touched = [r.slot for r in of.select(self._slot(of)).distinct().collect()]  # `slots` numbers at most
            rows = rows.filter(F.col("slot").isin(touched)).join(of.select(*(f"`{c}`" for c in self.by)), self.by, "left_semi")
        rows = rows.drop("part", "slot")
        return self.fold(rows) if folded else rows

    def batch(self, nth: int) -> DataFrame:
        """The rows of a batch that was added."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part=d{nth}").select(*(f"`{c}`" for c in self.schema.names))

    def add(self, nth: int, rows: DataFrame) -> None:
        self.schema = rows.schema
        if nth and nth % self.every == 0:
            self._write(self.rows(nth), f"w{nth}")
            # what the fold before was made of; this one's parts stay, as the batch may be repeated
            for old in range(max(0, nth - 2 * self.every), nth - self.every):
                self._drop(f"d{old}")
            if nth > 2 * self.every - 1:
                self._drop(f"w{nth - 2 * self.every}")
        self._write(rows, f"d{nth}")


class RunningScores:
    """The score of every sequence for each spec, as wide_scores() gives it for all counts so far, after any number of batches.

    A batch of counts (library, asv_id, n) is added to the numbers of its sequences. Where shares are asked for, it is also added to
    the totals of its bins, and all members of a touched bin have new shares, as its total has changed; else only the sequences
    that arrived have new values. Of these sequences the greatest value over all their bins (with anyfail the least) is their new
    score. Logs hold numbers by sequence, and scores; for shares also totals and members by bin. A batch reads those slots only in
    which its bins and sequences are, but for the totals, of which there is one a bin; a sweep reads scores. Where a batch touches
    half of all bins or more, all sequences are worked out anew: to look up which have new shares then takes longer.

    absorb() is made for foreachBatch: the numbers of batches count from 0, each batch may be repeated, in a new session too.
    Memberships mustn't change in between, hold no row twice and no null; counts that aren't positive or name no library or
    sequence are left out, as in the batch operator. path must be a folder that driver and executors share.
    """

    def __init__(self, spark: SparkSession, path: str, memberships: dict[str, DataFrame], specs: list[Spec], anyfail: bool = False, slots: int = 32, every: int = 16):
        self.spark, self.path, self.memberships, self.pick, self.done, self.logs = spark, path, memberships, F.min if anyfail else F.max, 0, []
        for i, (base, parts) in enumerate(dict.fromkeys((s.base, s.parts) for s in specs)):
            own = [s for s in specs if (s.base, s.parts) == (base, parts)]
            keys = [base, *parts]
            log = lambda name, by, fold, i=i: Log(spark, f"{path}/{name}-{i}", by, fold, slots, every)
            numbers = log("numbers", ["asv_id"], lambda rows, keys=keys: rows.groupBy(*keys, "asv_id").agg(F.sum("n").alias("n")))
            totals = log("totals", keys, lambda rows, keys=keys: rows.groupBy(*keys).agg(F.sum("bin_total").alias("bin_total")))
            members = log("members", keys, lambda rows: rows.distinct())
            latest = [F.max_by(f"`{s.name}`", "nth").alias(s.name) for s in own]
            scored = log("scores", ["asv_id"], lambda rows, latest=latest: rows.groupBy("asv_id").agg(*latest, F.max("nth").alias("nth")))
            self.logs.append((own, keys, numbers, totals, members, scored))

    def absorb(self, counts: DataFrame, nth: int) -> None:
        """Add a batch."""
        for i, (own, keys, numbers, totals, members, scored) in enumerate(self.logs):
            shares = any(s.metric == "p" for s in own)
            numbers.add(nth, binned(counts, self.memberships, own[0]).groupBy(*keys, "asv_id").agg(F.sum("n").alias("n")))
            came = numbers.batch(nth)  # counted once, read from here on
            changed = came
            if shares:
                totals.add(nth, came.groupBy(*keys).agg(F.sum("n").alias("bin_total")))
                members.add(nth, came.select(*keys, "asv_id"))
                touched = totals.batch(nth)
                changed = members.rows(nth + 1, of=touched, folded=False) if 2 * touched.count() < totals.rows(nth + 1).count() else None
            if changed is not None:
                at = f"{self.path}/changed-{i}"
                changed.select("asv_id").distinct().write.mode("overwrite").parquet(at)
                changed = self.spark.read.schema(came.select("asv_id").schema).parquet(at)
            now = numbers.rows(nth + 1, of=changed)
            measured = {"n": F.col("n").cast("double")}
            if shares:
                now = now.join(totals.rows(nth + 1), keys)
                measured["p"] = F.col("n").cast("double") / F.col("bin_total").cast("double")  # numbers are positive
            scores = now.groupBy("asv_id").agg(*(self.pick(measured[s.metric]).alias(s.name) for s in own))
            scored.add(nth, scores.withColumn("nth", F.lit(nth).cast("long")))
        self.done = nth + 1

    def scores(self) -> DataFrame:
        """(asv_id, a score for each spec, named as the spec) of all sequences that came in the batches so far; null where a
        sequence is in no bin of the spec."""
        if not self.done:
            raise ValueError("no batch has come yet")
        each = [scored.rows(self.done).drop("nth") for *_, scored in self.logs]
        return reduce(lambda a, b: a.join(b, "asv_id", "full"), each)
