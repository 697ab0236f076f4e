"""Token counts: end-of-document identifiers in flat token streams without an index."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pieces, stored

END = 65535
BLOCK = 1 << 17  # bytes
#: Blocks that a task reads in a row: 64 MB.
SPAN = 512
DTYPE = "<u2"


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Blocks (shard, block, payload) of flat binary token files of any size, each file a shard. Spark lists the files and their
    sizes; ranges of `span` blocks are dealt to tasks, which read theirs and no other, a block at a time. `block` is a multiple of
    the identifiers' size. Files may be in any store that pyarrow opens by its address (local, HDFS, S3, GCS); an empty
    file has no block. Files mustn't change while they are read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("shard"), F.col("length").alias("n")).filter("n > 0")
    ranges = files.withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / (block * span)).cast("long"))))
    tasks = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for shard, n, nth in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "range")), strict=True):
                if shard.startswith("file:"):
                    store, at = fs.LocalFileSystem(), "/" + shard[5:].lstrip("/")
                else:
                    store, at = fs.FileSystem.from_uri(shard)
                with store.open_input_file(at) as f:
                    for b in range(nth * span, min((nth + 1) * span, -(-n // block))):
                        raw = f.read_at(min(block, n - b * block), b * block)
                        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([b], pa.int64()), pa.array([raw], pa.binary())], names=["shard", "block", "payload"])

    # a fixed number of tasks, as few bytes tell of many to read
    return ranges.repartition(tasks, "shard", "range").mapInArrow(run, "shard string, block long, payload binary")


def scan_blocks(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """For each block its tokens, its ends of documents, where the first and the last stand (null: none), and the starts and lengths
    between ends (one less than the ends)."""

    def run(batches):
        for batch in pieces(batches, "payload", 8 << 20):
            size, ends, first, last, inner, starts = [], [], [], [], [], []
            for raw in batch.column("payload").to_pylist():
                ids = np.frombuffer(raw or b"", dtype)
                at = np.flatnonzero(ids == end)
                size.append(len(ids))
                ends.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
                starts.append(at[:-1] + 1)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in inner]))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())) for x in (starts, inner)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (size, ends, first, last)), *lists], names=names)

    names = ["shard", "block", "size", "ends", "first", "last", "starts", "inner"]
    kind = blocks.schema["shard"].dataType.simpleString()
    return blocks.select("shard", "block", "payload").mapInArrow(run, f"shard {kind}, block long, size long, ends long, first long, last long, starts array<long>, inner array<long>")


def token_counts(blocks: DataFrame, end: int = END, dtype: str = DTYPE, group: int = 1024) -> DataFrame:
    """A row for each document of flat token streams: shard, ordinal (from 0), start (its first token's place), n_tokens.

    blocks: (shard, block, payload), the blocks of a shard in order; they may cut documents anywhere, but not an identifier.
    A document ends with the identifier `end`, which isn't counted; tokens after the last end are a document without one.
    An empty stream has none; null payloads count as empty; equal (shard, block) rows aren't told apart and mustn't occur.

    Blocks are searched by themselves. A prefix scan then gives each block the place of its first token, the documents ended
    before it and the place of the last end before it: within groups of `group` blocks, over the groups' totals, and back, so
    that a long stream isn't one task.
    """
    scanned = stored(scan_blocks(blocks, end, dtype), "blocks").withColumn("group", F.floor(F.col("block") / group))
    order = Window.partitionBy("shard", "group").orderBy("block")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    local = scanned.withColumn("at", F.sum("size").over(upto) - F.col("size")).withColumn("ended", F.sum("ends").over(upto) - F.col("ends"))
    local = local.withColumn("open", F.max(F.col("at") + F.col("last")).over(before))
    totals = scanned.withColumn("at", F.sum("size").over(upto) - F.col("size")).groupBy("shard", "group").agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(F.col("at") + F.col("last")).alias("last"))
    over = Window.partitionBy("shard").orderBy("group")
    upto, before = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("g_at", F.sum("size").over(upto) - F.col("size")).withColumn("g_ended", F.sum("ends").over(upto) - F.col("ends"))
    totals = totals.withColumn("g_open", F.max(F.col("g_at") + F.col("last")).over(before)).withColumn("g_last", F.max("group").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    both = local.join(totals.select("shard", "group", "g_at", "g_ended", "g_open", "g_last"), ["shard", "group"])
    both = both.select("shard", (F.col("g_at") + F.col("at")).alias("at"), (F.col("g_ended") + F.col("ended")).alias("ended"), F.coalesce(F.col("g_at") + F.col("open"), "g_open", F.lit(-1)).alias("open"), "size", "ends", "first", "last", "starts", "inner")
    # the document that the first end closes may have begun in an earlier block
    head = both.filter("ends > 0").select("shard", F.col("ended").alias("ordinal"), (F.col("open") + 1).alias("start"), (F.col("at") + F.col("first") - F.col("open") - 1).alias("n_tokens"))
    rest = both.filter("ends > 1").select("shard", "ended", "at", F.posexplode(F.arrays_zip("starts", "inner")).alias("j", "own"))
    rest = rest.select("shard", (F.col("ended") + F.col("j") + 1).alias("ordinal"), (F.col("at") + F.col("own.starts")).alias("start"), F.col("own.inner").alias("n_tokens"))
    # tokens after a shard's last end
    tail = both.groupBy("shard").agg(F.sum("ends").alias("ordinal"), F.max(F.coalesce(F.col("at") + F.col("last"), F.lit(-1))).alias("open"), F.max(F.col("at") + F.col("size")).alias("all"))
    tail = tail.select("shard", "ordinal", (F.col("open") + 1).alias("start"), (F.col("all") - F.col("open") - 1).alias("n_tokens")).filter("n_tokens > 0")
    return head.union(rest).union(tail)


def word_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Flat streams of the texts, a shard for each partition: blocks (shard, block, payload), and what a writer of such files
    knows of their order (shard, ordinal, key). A token is a word (crc32 modulo 65535); a text ends with 65535."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches):
        shard, nth, ordinal, have = TaskContext.get().partitionId(), 0, 0, b""
        known: dict[bytes, int] = {}
        schema = None
        for batch in pieces(batches, "text"):
            schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("ordinal", pa.int64()), ("key", batch.schema.field("key").type)])
            out = []
            for x in batch.column("text").to_pylist():
                words = (x or "").encode().split()
                for w in words:
                    if w not in known:
                        known[w] = zlib.crc32(w) % END
                out.append(np.array([*map(known.__getitem__, words), END], DTYPE).tobytes())
                if len(known) > 1 << 19:
                    known.clear()
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("key")], schema=schema)
            ordinal += n
            have += b"".join(out)
            full = len(have) // block
            if full:
                yield pa.RecordBatch.from_arrays([pa.array([shard] * full, pa.int64()), pa.array(range(nth, nth + full), pa.int64()), pa.array([have[i * block : (i + 1) * block] for i in range(full)]), pa.nulls(full, pa.int64()), pa.nulls(full, schema.field("key").type)], schema=schema)
                nth, have = nth + full, have[full * block :]
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([nth], pa.int64()), pa.array([have]), pa.nulls(1, pa.int64()), pa.nulls(1, schema.field("key").type)], schema=schema)

    both = stored(picked.mapInArrow(run, f"shard long, block long, payload binary, ordinal long, key {kind}"), "stream")
    return both.filter("payload is not null").select("shard", "block", "payload"), both.filter("payload is null").select("shard", "ordinal", F.col("key").alias(key))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = word_stream(documents(spark, sf_dir))
    return order.join(token_counts(blocks), ["shard", "ordinal"]).select("doc_id", "n_tokens")


SQL = r"""SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents"""
