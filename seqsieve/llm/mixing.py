"""Mixing sources to target weights by pivotal dependent rounding. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, documents, shuffle_partitions, stored

#: Fixed weights of the query, repeating over the sources in code point order.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3

_ITEM = "struct<size:bigint,id:bigint,n:bigint,whole:bigint,p:double,u:double>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def ranked(groups: DataFrame, by: str) -> DataFrame:
    """Adds _rank, 0-based, in ascending order with null last, without a single task: rows are dealt by range and stored,
    counted by range, and the counts of the ranges before are added."""
    n = shuffle_partitions(groups.sparkSession)
    order = F.col(by).asc_nulls_last()
    dealt = stored(groups.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, total = [], 0
    for r, size in sorted(map(tuple, dealt.groupBy("_range").count().collect())):  # as many rows as ranges
        starts.append((r, total))
        total += size
    start = groups.sparkSession.createDataFrame(starts, "_range int, _start long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(start), "_range").withColumn("_rank", F.col("_start") + F.col("_within")).drop("_range", "_within", "_start")


def water_filled(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Adds target to rows (size, weight): the total shared by weight, no target above most * size, the excess reshared.

    Each round is one aggregate over the sources; level, the share of a weight of 1, only rises, so it ends."""
    cap, level = most * F.col("size"), None
    while True:
        full = F.lit(False) if level is None else cap <= level * F.col("weight")
        held, weight = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / weight if weight else level
        if level is not None and new <= level:
            break
        level = new or 0.0
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _unit(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on the values alone, so that reruns agree."""
    return (F.xxhash64(*cols).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)


def _pair(a: Column, b: Column) -> Column:
    """One pivotal step: mass in words moves between two fractional items, one way or the other with the probabilities that
    keep both expectations, until one of them is 0 or 1. The words expected of both together stay the same."""
    wa, wb = a["size"], b["size"]  # words of one more copy
    to_a, to_b = F.least((1 - a["p"]) * wa, b["p"] * wb), F.least(a["p"] * wa, (1 - b["p"]) * wb)
    up = b["u"] * (to_a + to_b) < to_b
    a_full, b_full = (1 - a["p"]) * wa <= b["p"] * wb, (1 - b["p"]) * wb <= a["p"] * wa
    pa_up, pb_up = F.when(a_full, 1.0).otherwise(a["p"] + to_a / wa), F.when(a_full, b["p"] - to_a / wb).otherwise(0.0)
    pa_down, pb_down = F.when(b_full, a["p"] - to_b / wa).otherwise(0.0), F.when(b_full, 1.0).otherwise(b["p"] + to_b / wb)
    clip = lambda p: F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)
    return F.struct(a.withField("p", clip(F.when(up, pa_up).otherwise(pa_down))).alias("a"), b.withField("p", clip(F.when(up, pb_up).otherwise(pb_down))).alias("b"))


def _fold(items: Column) -> Column:
    """All items of a leaf or node of the tree, one by one: struct of the integral ones and the fractional one left, if any."""
    state = "struct<open:%s,done:array<%s>>" % (_ITEM, _ITEM)
    start = F.struct(F.lit(None).alias("open"), F.array().alias("done")).cast(state)
    whole = lambda x: (x["p"] <= 0) | (x["p"] >= 1)

    def put(done: Column, x: Column) -> Column:
        return F.when(whole(x), F.concat(done, F.array(x))).otherwise(done)

    def step(s: Column, x: Column) -> Column:
        pair = F.transform(F.array(F.struct(s["open"].alias("a"), x.alias("b"))), lambda y: _pair(y["a"], y["b"]))[0]
        merged = F.transform(F.array(pair), lambda y: F.struct(F.when(~whole(y["a"]), y["a"]).when(~whole(y["b"]), y["b"]).alias("open"), put(put(s["done"], y["a"]), y["b"]).alias("done")))[0]
        return F.when(whole(x), F.struct(s["open"].alias("open"), F.concat(s["done"], F.array(x)).alias("done"))).when(s["open"].isNull(), F.struct(x.alias("open"), s["done"].alias("done"))).otherwise(merged).cast(state)

    return F.aggregate(items, start, step)


def settled(done: DataFrame, items: DataFrame, most: int, seed: int, slots: int = 4) -> DataFrame:
    """Rows (group, id, step): items that take one copy more or fewer, so that their group comes nearer to its words.

    What a group misses after the tree, less than its largest item, is made up by ever smaller items: of each doubling of sizes
    `slots` items that can give or take a copy are candidates, one aggregate each, so a group has few; from the largest down
    those step that lessen what is still missing, either way."""
    copies = F.col("item.whole") + F.col("item.p").cast("long")
    # decimals, so that the sum doesn't depend on the order of rows
    want = items.groupBy("group").agg(F.sum((F.col("n") * F.col("copies") * F.col("size")).cast("decimal(38,6)")).cast("double").alias("want"))
    got = done.groupBy("group").agg(F.sum(copies * F.col("item.size")).alias("got"))
    miss = want.join(got, "group").select("group", (F.col("want") - F.col("got")).alias("miss"))
    rows = done.select("group", F.col("item.size").alias("size"), F.col("item.id").alias("id"), (copies < most * F.col("item.n")).alias("more"), (copies > 0).alias("fewer"))
    slot = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("id")), F.lit(slots))
    one = F.struct("size", "id")
    picked = rows.groupBy("group", F.floor(F.log2("size")).alias("band"), slot.alias("slot")).agg(F.min(F.when(F.col("more"), one)).alias("more"), F.min(F.when(F.col("fewer"), one)).alias("fewer"))
    each = picked.select("group", F.explode(F.array(F.struct("more.*", F.lit(1).alias("step")), F.struct("fewer.*", F.lit(-1).alias("step")))).alias("x")).filter("x.id is not null")
    lists = each.groupBy("group").agg(F.sort_array(F.collect_list("x"), asc=False).alias("all")).join(miss, "group")
    state = "struct<left:double,taken:array<struct<id:bigint,step:bigint>>>"
    start = F.struct(F.col("miss").alias("left"), F.array().alias("taken")).cast(state)

    def step(s: Column, x: Column) -> Column:
        new = s["left"] - x["step"] * x["size"]
        return F.when(F.abs(new) < F.abs(s["left"]), F.struct(new.alias("left"), F.concat(s["taken"], F.array(F.struct(x["id"].alias("id"), x["step"].cast("long").alias("step")))).alias("taken")).cast(state)).otherwise(s)

    chosen = lists.select("group", F.explode(F.aggregate("all", start, step)["taken"]).alias("x"))
    return chosen.groupBy("group", "x.id").agg(F.sum("x.step").alias("step"))


def pivotal_copies(items: DataFrame, most: int = MOST_COPIES, seed: int = 0, leaf: int = 48) -> DataFrame:
    """Rounds rows (group, id, n, size, copies: double) to rows (group, id, copies: long).

    An item stands for n equal rows and has n * copies expected copies in all; ids are distinct in a group.  Items are dealt by hash to leaves of about `leaf` items;
    a leaf passes on the one item left fractional, and nodes combine `leaf` of these, up to one node a group, whose last
    is rounded to the nearer side; what the group then misses, half an item's size at most, is settled by smaller items, none of
    which takes more than `most` copies a row. A group of any size is thus spread over many tasks.
    """
    spark = items.sparkSession
    mass = F.col("n") * F.col("copies")
    x = items.select("group", F.struct(F.col("size"), F.col("id"), F.col("n"), F.floor(mass).cast("long").alias("whole"), (mass - F.floor(mass)).alias("p"), F.lit(0.0).alias("u")).cast(_ITEM).alias("item"))
    counts = items.groupBy("group").agg(F.count("*").alias("_items"))
    largest = counts.agg(F.max("_items")).first()[0] or 0
    levels, nodes = [], 1
    while nodes < largest / leaf:
        levels.append(nodes)
        nodes *= leaf
    levels.append(nodes)
    out = []
    for depth, nodes in enumerate(reversed(levels)):
        last = depth == len(levels) - 1
        drawn = x.withColumn("item", F.col("item").withField("u", _unit(F.lit(seed), F.lit(depth), F.col("item.id"))))
        node = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("item.id")), F.lit(nodes))
        folded = drawn.groupBy("group", node.alias("node")).agg(_fold(F.sort_array(F.collect_list("item"), asc=False)).alias("s"))
        folded = stored(folded, "pivotal")
        out.append(folded.select("group", F.explode("s.done").alias("item")))
        x = folded.filter("s.open is not null").select("group", F.col("s.open").alias("item"))
        if last:
            out.append(x.withColumn("item", F.col("item").withField("p", F.when(F.col("item.p") < 0.5, 0.0).otherwise(1.0))))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    steps = settled(done, items, most, seed)
    copies = F.col("item.whole") + F.col("item.p").cast("long")
    return done.select("group", F.col("item.id").alias("id"), copies.alias("copies")).join(steps, ["group", "id"], "left").select("group", "id", (F.col("copies") + F.coalesce("step", F.lit(0))).cast("long").alias("copies"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, salts: int = 16) -> DataFrame:
    """Rows (key, source, size, n, source_size, target, copies): of each set of n equal rows (key, source and size in words) the
    copies that the mix takes, in all at most `most` a row."""
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = stored(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "sizes")
    own = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    weight = F.array(*(F.lit(float(w)) for w in weights))
    own = ranked(own, "source").withColumn("weight", F.get(weight, (F.col("_rank") % len(weights)).cast("int")))
    own = stored(own, "sources")
    total = float(own.agg(F.sum("size")).first()[0] or 0)
    own = water_filled(own, total, most).select("source", F.col("size").alias("source_size"), "target", F.col("_rank").alias("group"))
    # a hot source is spread over `salts` tasks in the join
    salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("key", "size"), F.lit(salts)).cast("int"))
    both = left.alias("l").join(salted.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.salt") == F.col("r.salt")))
    both = both.select("key", F.col("l.source").alias("source"), "size", "n", "source_size", "target", "group", F.xxhash64("key", "size", "group").alias("id"))
    both = stored(both, "mixing")
    items = both.filter("size > 0").groupBy("group", "id").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.max(F.col("target") / F.col("source_size")).alias("copies"))
    made = pivotal_copies(items, most, seed)
    return both.join(made, ["group", "id"], "left").withColumn("copies", F.coalesce("copies", F.lit(0).cast("long"))).drop("group", "id")


def _share(nth: Column) -> Column:
    """Of the copies of n equal rows those of the nth (from 0)."""
    return F.floor(F.col("copies") / F.col("n")).cast("long") + F.when(nth < F.col("copies") % F.col("n"), 1).otherwise(0)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """A row for each row of docs: the key, size (words), source_size, target (of its source) and taken (words, repeats counted).

    Sources in code point order, null last, weigh `weights`, repeating, and share all sizes; a target stops at `most` times
    its source's size, the excess is reshared. Words taken of a source come within about its smallest document of its target; a document
    is taken at most `most` times. Equal rows (key, source, size) are rounded together. Empty and null texts have size 0 and
    taken 0; other columns don't matter; an empty table gives none. Options: those of plan().
    """
    out = plan(docs, key, text, source, **options)
    out = out.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (_share(F.col("j")) * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs, all its columns, as often as mix() takes it; those without words are left out."""
    names = docs.columns
    made = plan(docs, key, text, source, **options).select(F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "copies").filter("copies > 0")
    made = made.withColumnsRenamed({"n": "_n", "copies": "_c"})
    rows = docs.withColumn("_size", word_count(F.col(text))).join(made, F.col(key).eqNullSafe(F.col("_k")) & F.col(source).eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    one = rows.filter("_n = 1").withColumn("_times", F.col("_c"))
    # rows alike but for other columns: any order will do. They are numbered within their parts, and the parts' sizes summed up
    more = stored(rows.filter("_n > 1").withColumn("_part", F.spark_partition_id()), "alike")
    alike = [F.coalesce(F.col("_k").cast("string"), F.lit("")), F.col("_k").isNull(), F.coalesce(F.col("_s").cast("string"), F.lit("")), F.col("_s").isNull(), F.col("_size")]
    more = more.withColumn("_same", F.struct(*alike))
    upto = Window.partitionBy("_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = more.groupBy("_same", "_part").agg(F.count("*").alias("_rows")).select("_same", "_part", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_same", "_part").orderBy(F.lit(0)))
    more = more.withColumn("_within", within).join(parts, ["_same", "_part"])
    share = F.floor(F.col("_c") / F.col("_n")).cast("long") + F.when(F.col("_before") + F.col("_within") <= F.col("_c") % F.col("_n"), 1).otherwise(0)
    more = more.withColumn("_times", share).filter("_times > 0")
    return one.select(*names, "_times").union(more.select(*names, "_times")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
