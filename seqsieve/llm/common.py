"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one is made where a local session has none."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not (path := getattr(spark, "_seqsieve_scratch", None)):
        path = spark._seqsieve_scratch = tempfile.mkdtemp(prefix="spark-")
    return path


#: Paths of the tables stored within the innermost settled(), None outside of any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a lost executor then costs no recomputation."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, stored. The tables that make() stored on its way are deleted then: nothing reads them any longer, so
    the shared folder holds one step's tables at a time. make() must not hand out other DataFrames over these."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        out = make()
        path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
    finally:
        _MADE.reset(before)
    if (outer := _MADE.get()) is not None:
        outer.append(path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for old in made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(hadoop).delete(at, True)
    return spark.read.schema(out.schema).parquet(path)


#: Rows of a batch between the JVM and Python: of texts of some KB a few MB. Both sides hold a batch as a whole, and the JVM
#: doubles its buffers as they fill.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH_ROWS, where they are more (10,000 by default), as rows here hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of the given names renamed, whatever their case, and how to name them again: for withColumnsRenamed()."""
    taken, back = {c.lower() for c in docs.columns} | {n.lower() for n in names}, {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"own{c}"
            while new.lower() in taken:
                new = f"own{new}"
            taken.add(new.lower())
            back[new] = c
    return docs.withColumnsRenamed({v: k for k, v in back.items()}), back


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else left."""
    return F.translate(col, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What an operator keeps in a Python worker for its next tasks, by the operator's name.
KEPT: dict[str, object] = {}


def pieces(batches: Iterator[pa.RecordBatch], col: str, most: int = 4 << 20, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, whole rows always, so that memory stays bounded. What other
    operators than `keeps` have kept in this worker is let go."""
    for name in [x for x in KEPT if x != keeps]:
        del KEPT[name]
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bits of a bitmap for each key, and its bits at most (8 MB). Up to FEW keys need none, as Spark broadcasts such a list itself.
#: The columns that marked() adds for itself.
KEY_BITS, MOST_BITS, FEW = 16, 1 << 26, 1 << 14
MARK_COLUMNS = ("_mark", "_place", "_bucket", "_bits")


def marked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df and _mark: true for each row whose key is one of keys (stored), and for few others. A bitmap of the keys' hashes is
    broadcast, which is bounded however many they are, so that rows of texts needn't be shuffled to learn that most have no match."""
    bits, wanted = 1 << 15, min(KEY_BITS * keys.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2
    place = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("_place")
    maps = keys.select(place).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    rows = df.select("*", place).withColumn("_bucket", F.bitmap_bucket_number("_place")).join(F.broadcast(stored(maps, "marks")), "_bucket", "left")
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_place) div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"coalesce(shiftright({byte}, cast(bitmap_bit_position(_place) % 8 as int)) & 1, 0) = 1")
    return rows.select(*df.columns, bit.alias("_mark"))


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df that may have a match in keys (stored): all that have, and few others; for a join that follows."""
    return marked(df, keys, key).filter("_mark").drop("_mark") if keys.count() > FEW else df


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is none of keys (stored). Only those that may be one are shuffled to tell."""
    if keys.count() <= FEW:
        return df.join(keys, key, "left_anti")
    rows = marked(df, keys, key)
    return rows.filter("not _mark").drop("_mark").unionByName(rows.filter("_mark").drop("_mark").join(keys, key, "left_anti"))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of each u. The minima (combined before the shuffle) are stored, so that the join is fed by
    plain shuffles and a node of many edges can be split."""
    low = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(low, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps, each a minimum by node (combined before the shuffle) and an equi-join,
    until the edges are a forest of stars; every round is stored. Self-loops keep a node that has no other edge.
    """
    spark = edges.sparkSession
    nodes = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    e = nodes.filter("u != v")

    def turn(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        star = _least_neighbour(large)
        return star.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(star.select("u", F.col("m").alias("v"))).filter("u != v").distinct()

    def stars(e: DataFrame) -> bool:
        """Whether no node is both a leaf and a centre, and no leaf has two centres."""
        leaf = e.groupBy("u").agg(F.count("*").alias("n"))
        return leaf.filter("n > 1").limit(1).union(leaf.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)).isEmpty()

    while not stars(e):
        e = settled(spark, "edges", lambda: turn(e))  # noqa: B023
    every = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(e.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def grown(parts: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components (node, component), stored, that components() has given, after more edges: these are led to the components
    of their ends, so that the rounds run over the new edges only. Nodes that parts hasn't count as components of their own."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    led = edges.select(a, b).join(of(a), a, "left").join(of(b), b, "left")
    moved = stored(components(led.select(F.coalesce(f"of_{a}", a).alias("a"), F.coalesce(f"of_{b}", b).alias("b"))), "moved")
    old = parts.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    fresh = moved.join(parts.select("node"), "node", "left_anti")
    return stored(old.select("node", F.coalesce("to", "component").alias("component")).union(fresh.select("node", "component")), "parts")
