"""The sequence domain laid over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import folder  # noqa: F401

#: Thresholds of the registered sweeps.
SWEEP = "[library; n; 25-100/4] * [library; p; 0.0005-0.007/14]"
ADDITIVE = "[library; n; 25-100/4] + [library; p; 0.0005-0.007/14] + [library|clade; p; 0.05-0.5/10]"
WIDE = "[library; n; 1-100/30] * [library; p; 0.0001-0.007/30] * [library|clade; p; 0.01-0.5/30]"
LIBRARY_P = "[library; p; 0.0005-0.007/14]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries are suppliers, sequences parts, reads quantities."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("library"), F.col("l_partkey").alias("asv_id"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("n"))


def asvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are the smallest parts, non-targets the largest."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asv_id"), (F.col("p_size") <= 5).alias("is_target"), (F.col("p_size") >= 46).alias("is_nontarget"))


def memberships(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part")
    return {k: part.select(F.col(c).alias("group_id"), F.col("p_partkey").alias("asv_id")) for k, c in (("clade", "p_brand"), ("taxon", "p_type"))}


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asv_ord, asv_id, seq): 58 to 64 bases made from each document's number."""
    d = F.col("doc_id").cast("string")
    whole = F.translate(F.concat(F.md5(F.concat(d, F.lit(":0"))), F.md5(F.concat(d, F.lit(":1")))), "0123456789abcdef", "ACGTACGTACGTACGT")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asv_ord"), F.col("doc_id").alias("asv_id"), F.substring(whole, F.lit(1), (58 + F.col("doc_id") % 7).cast("int")).alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, ref_seq): every tenth sequence within other bases, every twentieth of them reversed and complemented."""
    from ..functions.sequence import reverse_complement

    s = sequences(spark, sf_dir).filter("asv_id % 10 = 0")
    inside = F.concat(F.lit("ACGTAC"), "seq", F.lit("GGTT"))
    return s.select(F.col("asv_id").alias("ref_id"), F.when(F.col("asv_id") % 20 == 0, reverse_complement(inside)).otherwise(inside).alias("ref_seq"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asv_ord, seq): for each supplier its nation's 64 bases with four of them changed."""
    n = F.col("s_nationkey").cast("string")
    base = F.translate(F.concat(F.md5(n), F.md5(F.concat(n, F.lit(":1")))), "0123456789abcdef", "ACGTACGTACGTACGT")
    own = F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 4), "0123456789abcdef", "ACGTACGTACGTACGT")
    at = (F.col("s_suppkey") % 60).cast("int")
    seq = F.concat(F.substring(base, F.lit(1), at), own, F.substring(base, at + 5, F.lit(64)))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asv_ord"), seq.alias("seq"))
