"""Best sets, unique compositions, the result store and what is retained (A-11 to A-13, T-2, T-3, T-6, W-5, U-4, U-6, K-3, F-10, F-11, X-14)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def best_sets(results: DataFrame, metric: str = "accuracy_score") -> DataFrame:
    """The rows that reach the highest score."""
    return results.join(F.broadcast(results.agg(F.max(metric).alias("_best"))), F.col(metric) == F.col("_best")).drop("_best")


def top_proportion(results: DataFrame, metric: str, share: float) -> DataFrame:
    """The rows whose score is among the top share (0 to 1) of the distinct scores, one at least. The ranking is over the
    distinct scores, not over the rows."""
    distinct = results.select(metric).distinct()
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.orderBy(F.col(metric).desc()))).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(1))))
    least = ranked.filter(F.col("_rank") <= F.greatest(F.lit(1), F.round(F.lit(share) * F.col("_all")))).agg(F.min(metric).alias("_least"))
    return results.join(F.broadcast(least), F.col(metric) >= F.col("_least")).drop("_least")


def unique_compositions(results: DataFrame) -> DataFrame:
    """Of the sets with the same actual rejects the one of the least index: (resultindex, sets)."""
    return results.groupBy("rejects_hash").agg(F.min("resultindex").alias("resultindex"), F.count("*").alias("sets")).drop("rejects_hash")


def bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bits) of rows (keys, asv_ord), asv_ord from 0: a bit for each number, 32,768 to a bucket."""
    at = F.col("asv_ord") + 1
    return rows.groupBy(*keys, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


@F.pandas_udf(BinaryType())
def _without(bits: pd.Series, others: pd.Series) -> pd.Series:
    """Bits that the others don't have; null: none."""
    less = lambda x, y: x if y is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes()
    return pd.Series([less(x, y) for x, y in zip(bits, others, strict=True)])


def _complement(rows: DataFrame, sets: DataFrame, whole: DataFrame) -> DataFrame:
    """(resultindex, bucket, bits) of what is in `whole` (bucket, bits) but not in a set's rows, for each of the chosen sets."""
    chosen = sets.agg(F.collect_set("resultindex").alias("_sets"))  # one row of the chosen sets' numbers
    every = whole.crossJoin(F.broadcast(chosen)).select("bucket", F.col("bits").alias("_whole"), F.explode("_sets").alias("resultindex"))
    return every.join(rows.select("resultindex", "bucket", "bits"), ["resultindex", "bucket"], "left").select("resultindex", "bucket", _without("_whole", "bits").alias("bits"))


def encode_store(rejected: DataFrame, asvs: DataFrame) -> DataFrame:
    """(resultindex, action, bucket, bits): the rejects if they are under half of all, else the retained, as bitmaps (U-6).

    rejected: (resultindex, asv_ord) of chosen sets; sets without rejects aren't in it. asvs: all (asv_ord), from 0. A row holds
    32,768 sequences; which side is smaller is told by counting bits, and the retained are made by bit operations."""
    out, whole = bitmaps(rejected, "resultindex"), bitmaps(asvs)
    total = whole.agg(F.sum(F.bitmap_count("bits")).alias("_all"))
    sizes = out.groupBy("resultindex").agg(F.sum(F.bitmap_count("bits")).alias("_out")).crossJoin(F.broadcast(total))  # one row
    few = sizes.filter(F.col("_out") < F.col("_all") * 0.5).select("resultindex")
    many = sizes.filter(F.col("_out") >= F.col("_all") * 0.5).select("resultindex")
    kept = _complement(out.join(many, "resultindex", "left_semi"), many, whole)
    act = lambda df, name: df.select("resultindex", F.lit(name).alias("action"), "bucket", "bits")
    return act(out.join(few, "resultindex", "left_semi"), "reject").union(act(kept, "retain"))


def store_of_ids(lines: DataFrame, asvs: DataFrame) -> DataFrame:
    """encode_store()'s rows from read_store()'s (resultindex, action, asv_ids), with asvs: (asv_id, asv_ord)."""
    rows = lines.select("resultindex", "action", F.explode("asv_ids").alias("asv_id")).join(asvs.select("asv_id", "asv_ord"), "asv_id")
    return lines.select("resultindex", "action").join(bitmaps(rows, "resultindex"), "resultindex", "left")


def retained(asvs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The sequences of one set that stay (K-3)."""
    return asvs.join(rejected.select("asv_id"), "asv_id", "left_anti")


def retained_from_store(asvs: DataFrame, store: DataFrame) -> DataFrame:
    """(resultindex, asv columns) of each stored set (S-12, U-4); asvs has asv_ord."""
    keep = store.filter("action = 'retain' and bits is not null").select("resultindex", "bucket", "bits")
    out = store.filter("action = 'reject'")
    rest = _complement(out, out.select("resultindex").distinct(), bitmaps(asvs))

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, bucket, bits in zip(batch["resultindex"], batch["bucket"], batch["bits"], strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                yield pd.DataFrame({"resultindex": index, "asv_ord": (bucket - 1) * 32768 + at})

    return keep.union(rest).mapInPandas(numbers, "resultindex long, asv_ord long").join(asvs, "asv_ord").select("resultindex", *asvs.columns)


def stored_twins(indices: DataFrame, hashes: DataFrame, store: DataFrame) -> DataFrame:
    """(resultindex, stored): for each wanted set the least stored one with the same rejects, itself if it is stored, by the hash
    store's fingerprints; wanted sets without any aren't in it (K-2)."""
    have = store.select(F.col("resultindex").alias("stored")).distinct()
    same = indices.join(hashes, "resultindex").join(hashes.withColumnRenamed("resultindex", "stored"), "rejects_hash").join(have, "stored", "left_semi").select("resultindex", "stored")
    own = indices.join(have.withColumn("resultindex", F.col("stored")), "resultindex").select("resultindex", "stored")
    return same.union(own).groupBy("resultindex").agg(F.min(F.struct(F.col("stored") != F.col("resultindex"), "stored")).alias("s")).select("resultindex", "s.stored")


def hash_store(results: DataFrame) -> DataFrame:
    """(resultindex, rejects_hash): which sets reject the same, by index, so that a later dump needs no sweep (K-2)."""
    return results.select("resultindex", "rejects_hash")


def within_rates(results: DataFrame, fp: float, fn: float) -> DataFrame:
    """Sets that keep at most the share fp of the non-authentic and lose at most fn of the authentic (F-11)."""
    return results.filter((F.col("verifiednonauthentic_retained_p") <= fp) & (F.col("verifiedauthentic_rejected_p") <= fn))


def single_terms(results: DataFrame) -> DataFrame:
    """Sets of one spec (F-12)."""
    return results.filter(~F.col("term").contains("*"))


def long_stats(results: DataFrame, names: list[str]) -> DataFrame:
    """(resultindex, term, threshold, stat, value): thresholds and statistics of single-spec sets, unpivoted (X-14, J-8)."""
    at: Column = F.coalesce(*(F.when(F.col("term") == n, F.col(f"`{n}_threshold`")) for n in names))
    stats = [c for c in results.columns if c.endswith(("_n", "_p")) and not c.endswith("_threshold")]
    rows = single_terms(results).withColumn("threshold", at).select("resultindex", "term", "threshold", *(F.col(c).cast("double").alias(c) for c in stats))
    return rows.unpivot(["resultindex", "term", "threshold"], stats, "stat", "value")


def describe_terms(results: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Adds description: the label of the term (J-9), null if it has none."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return results.withColumn("description", F.try_element_at(F.create_map(*pairs), F.col("term")) if pairs else F.lit(None).cast("string"))
