"""FASTA, FASTQ, count tables, taxa, control lists and result stores (S-1 to S-16, K-1 to K-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import base_name, library_of_header, plain_name


class FormatError(ValueError):
    """A file that isn't what it should be."""


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(asv_ord, asv_id, asv_key, header, seq, len, path) in the order of the file.

    Records are split at ">" after a line break, so a file is read by many tasks; their order is the place in the file."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    raw = raw.filter(F.trim("value") != "").withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^>", ""), "\r", ""))
    header = F.element_at(F.split("value", "\n", 2), 1)
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    rows = raw.select("path", "_block", "_row", header.alias("header"), body.alias("seq"))
    rows = rows.withColumn("asv_id", F.regexp_extract("header", r"^\S*", 0)).withColumn("asv_key", plain_name(F.col("asv_id")))
    return rows.select(F.col("_row").alias("asv_ord"), "asv_id", "asv_key", "header", "seq", F.length("seq").alias("len"), "path")


def numbered(rows: DataFrame) -> DataFrame:
    """asv_ord from 0 without gaps, in the same order: counts by partition are added up, rows are numbered within."""
    from pyspark.sql import Window

    rows = rows.withColumn("_part", F.shiftrightunsigned("asv_ord", 33))
    starts, total = [], 0
    for part, size in sorted(map(tuple, rows.groupBy("_part").count().collect())):  # as many rows as partitions
        starts.append((part, total))
        total += size
    start = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy("asv_ord")) - 1
    placed = rows.withColumn("_within", within).join(F.broadcast(start), "_part")
    return placed.withColumn("asv_ord", F.col("_start") + F.col("_within")).drop("_part", "_start", "_within").select(*[c for c in rows.columns if c != "_part"])


def check_unique(rows: DataFrame, column: str) -> None:
    if again := rows.groupBy(column).count().filter("count > 1").first():
        raise FormatError(f"{again[0]!r} occurs {again['count']} times as {column}")


def is_aligned(asvs: DataFrame, first: int = 1000) -> bool:
    """Whether the first sequences have one length (S-2)."""
    low, high = asvs.orderBy("asv_ord").limit(first).agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    return low == high


def sniff(spark: SparkSession, path: str) -> str:
    """fastq or fasta by the file's first letter (S-4)."""
    row = spark.read.text(path).filter(F.trim("value") != "").first()
    kind = {"@": "fastq", ">": "fasta"}.get(row.value[:1]) if row else None
    if not kind:
        raise FormatError(f"{path} is neither FASTA nor FASTQ")
    return kind


def numbered_lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """(path, nth, value): the lines of text files, or what else sep parts, numbered from 0 in each. A file is read in splits by many tasks; the lines
    are counted by split and the counts of the splits before are added, a row for each split."""
    from pyspark.sql import Window

    lines = spark.read.text(path, lineSep=sep).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    upto = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = starts.select("path", "_block", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    return lines.join(starts, ["path", "_block"]).select("path", (F.col("_start") + F.col("_row") - F.col("_first")).alias("nth"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq, path). Records are four lines; of these the first two are grouped by the record's number, so that a file of
    any size is read by many tasks."""
    lines = numbered_lines(spark, path).filter("nth % 4 < 2").withColumn("_record", F.floor(F.col("nth") / 4))
    part = lambda i: F.max(F.when(F.col("nth") % 4 == i, F.col("value")))
    rows = lines.groupBy("path", "_record").agg(part(0).alias("header"), part(1).alias("seq")).filter("header != '' and seq is not null")
    return rows.select(F.expr("substring(header, 2)").alias("header"), F.rtrim("seq").alias("seq"), "path")


def read_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(library, seq): several files are a library each, named as the file; of one file each header names its read's (S-5, S-6)."""
    parts = [(read_fastq if sniff(spark, p) == "fastq" else read_fasta)(spark, p).select("header", F.upper("seq").alias("seq"), "path") for p in paths]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    if len(paths) > 1:
        names = [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in paths]
        if len(set(names)) < len(names):
            raise FormatError("two read files have the same name")
        return rows.select(base_name(F.col("path")).alias("library"), "seq")
    return rows.select(library_of_header(F.regexp_extract("header", r"^\S*", 0)).alias("library"), "seq")


def match_reads(reads: DataFrame, asvs: DataFrame) -> DataFrame:
    """(library, asv_id) of the reads that equal a sequence (J-1). Matching reads must name a library."""
    key = lambda seq: F.xxhash64(seq)
    left = reads.withColumn("_h", key(F.col("seq")))
    right = asvs.select("asv_id", F.upper("seq").alias("asv_seq")).withColumn("_h", key(F.col("asv_seq")))
    rows = left.join(right, (left["_h"] == right["_h"]) & (F.col("seq") == F.col("asv_seq")))
    named = F.when(F.col("library") == "", F.raise_error(F.lit("a read that matches names no library"))).otherwise(F.col("library"))
    return rows.select(named.alias("library"), "asv_id")


def read_counts(spark: SparkSession, path: str, asvs: DataFrame) -> DataFrame:
    """(library, asv_id, n), n > 0, from a comma- or tab-separated table of sequences by libraries, either way round, with or
    without a name in the header's corner (S-7). Names may lack or have their ;size= tag."""
    first = spark.read.text(path).first().value
    if ("," in first) == ("\t" in first):
        raise FormatError("the header must have either commas or tabs")
    sep = "," if "," in first else "\t"
    lines = spark.read.text(path).filter("value != ''").withColumn("_f", F.split("value", sep))
    width = lines.filter(F.col("value") != first).agg(F.min(F.size("_f")), F.max(F.size("_f"))).first()
    names = first.rstrip("\r").split(sep)
    if width[0] != width[1] or width[0] - len(names) not in (0, 1):
        raise FormatError("rows differ in their number of fields")
    names = names[1:] if width[0] == len(names) else names
    if len(set(names)) < len(names):
        raise FormatError("a name occurs twice in the header")
    rows = lines.filter(F.col("value") != first).select(F.get("_f", F.lit(0)).alias("row"), F.posexplode(F.slice("_f", 2, len(names))))
    rows = rows.select("row", "pos", F.expr("cast(trim(replace(col, '\r', '')) as bigint)").alias("n")).filter("n > 0")
    # a table of the header's names, as a header of many is too long for an expression
    rows = rows.join(spark.createDataFrame(list(enumerate(names)), "pos int, column string"), "pos").select("row", "column", "n")
    known = asvs.select(F.col("asv_id").alias("name"), "asv_id").union(asvs.select(F.col("asv_key").alias("name"), "asv_id")).distinct()
    across = known.join(spark.createDataFrame([(n,) for n in names], "name string"), "name", "left_semi").limit(1).isEmpty()
    name, library = ("row", "column") if across else ("column", "row")
    return rows.join(known, rows[name] == known["name"]).select(F.col(library).alias("library"), "asv_id", "n")


def read_taxa(spark: SparkSession, path: str, asvs: DataFrame | None = None) -> DataFrame:
    """(group_id, asv_id) from a table without header: sequence, taxon. With asvs, both must name the same (S-8, U-5)."""
    rows = spark.read.schema("asv_id string, group_id string").csv(path).select("group_id", "asv_id")
    if asvs is not None:
        for a, b, what in ((rows, asvs, "isn't a sequence"), (asvs, rows, "has no taxon")):
            if odd := a.select("asv_id").join(b.select("asv_id"), "asv_id", "left_anti").first():
                raise FormatError(f"{odd[0]!r} {what}")
    return rows


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """(asv_id, reason) from tab-separated lines reason, sequence (S-11)."""
    return spark.read.schema("reason string, asv_id string").option("sep", "\t").csv(path).select("asv_id", "reason")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(resultindex, action, asv_ids) from lines index, action, sequences, tab-separated (S-12)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(F.expr("try_cast(split(value, '\t')[0] as bigint)").alias("resultindex"), F.get(f, F.lit(1)).alias("action"), F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))).alias("asv_ids"))
    if not rows.filter("resultindex is null or action is null or action not in ('reject', 'retain')").isEmpty():
        raise FormatError(f"{path} has lines that aren't: index, reject or retain, sequences")
    return rows


def write_store(store: DataFrame, path: str) -> None:
    store.select(F.concat_ws("\t", F.col("resultindex").cast("string"), "action", F.concat_ws("\t", F.col("asv_ids").cast("array<string>"))).alias("value")).write.text(path, compression="gzip")


def fasta_lines(asvs: DataFrame) -> DataFrame:
    return asvs.orderBy("asv_ord").select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"))


def write_result_sets(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of FASTA for each resultindex (K-4)."""
    rows.select("resultindex", "asv_ord", F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).sort("resultindex", "asv_ord").select("resultindex", "value").write.mode(mode).partitionBy("resultindex").text(path)


def libraries_without_hits(reads: DataFrame, matched: DataFrame) -> DataFrame:
    """(library) of read libraries none of whose reads equals a sequence (A-14): a warning's rows."""
    return reads.select("library").distinct().join(matched.select("library").distinct(), "library", "left_anti")
