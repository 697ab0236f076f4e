"""Reads counted as they arrive, by library and sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import library_of_header


def running_counts(reads: DataFrame) -> DataFrame:
    """(library, asv_id, n) so far, for update or complete output. reads: a stream of (header, asv_id)."""
    return reads.select(library_of_header(F.col("header")).alias("library"), "asv_id").filter("library != ''").groupBy("library", "asv_id").agg(F.count("*").alias("n"))


def windowed_counts(reads: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, library, asv_id, n) by window of event time; reads later than `late` are left out, so state stays bounded."""
    rows = reads.withWatermark(ts, late).select(ts, library_of_header(F.col("header")).alias("library"), "asv_id").filter("library != ''")
    return rows.groupBy(F.window(ts, width), "library", "asv_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "library", "asv_id", "n")


def dealt_files(rows: DataFrame, path: str, batches: int, most: int = 1 << 18) -> int:
    """Writes rows as files of about `most` rows, so that no task that reads a batch has all of it; the number of files that
    make up one of the batches is returned."""
    files = max(batches, -(-rows.count() // most))
    rows.repartition(files).write.parquet(path)
    return -(-files // batches)
