"""Newick trees as tables: read, cut at a height, and written from merges (S-9, H-4, K-6).

Between two commas of a Newick text stands just one tip, after the brackets that open before it and with those that close after
it. So a tree is a table of such pieces, in order; what lies between a bracket and its partner is told by prefix sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import FormatError, numbered_lines
from .prefix import running_sums
from .rounds import stored

#: A name, quoted or not, and a branch's length; a quoted name may not hold a comma or a bracket.
_NAME, _LENGTH = r"(?:'[^'(),]*'|[^\s'(),:;]*)", r"(?:\s*:\s*[-+0-9.eE]+)?"
_PIECE = rf"^\s*((?:\(\s*)*)({_NAME})({_LENGTH})\s*((?:\)\s*{_NAME}{_LENGTH}\s*)*)(;?)\s*$"


def _length(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r":\s*(\S+)", 1).try_cast("double"), F.lit(0.0))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(piece, name, length, opens, closers): the tips of a tree file, or of a folder's files in order of their names, in order
    from 0; closers: the lengths of the branches whose brackets close after the tip. Files are read in splits, at commas."""
    rows = numbered_lines(spark, path, ",")
    many = [r.path for r in rows.select("path").distinct().collect()]  # files of one tree
    if len(many) > 1:
        sizes = {r.path: r.n for r in rows.groupBy("path").agg(F.count("*").alias("n")).collect()}
        start, starts = 0, []
        for p in sorted(many):
            starts.append((p, start))
            start += sizes[p]
        rows = rows.join(F.broadcast(spark.createDataFrame(starts, "path string, start long")), "path").withColumn("nth", F.col("nth") + F.col("start"))
    # a folder's files end between two pieces, each with its comma: what is left after the last is empty
    rows = rows.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").select("nth", "value")
    part = lambda i: F.regexp_extract("value", _PIECE, i)
    bad = F.raise_error(F.concat(F.lit("no piece of a Newick tree: "), F.substring("value", 1, 200)))
    rows = rows.select("nth", F.when(F.col("value").rlike(_PIECE), F.struct(part(1).alias("o"), part(2).alias("name"), part(3).alias("len"), part(4).alias("c"))).otherwise(bad).alias("p"))
    closed = F.split("p.c", r"\)")
    out = rows.select("nth", F.regexp_replace("p.name", r"^'|'$", "").alias("name"), _length(F.col("p.len")).alias("length"), F.length(F.regexp_replace("p.o", r"\s", "")).alias("opens"), F.transform(F.slice(closed, 2, F.greatest(F.size(closed) - 1, F.lit(0))), _length).alias("closers"))
    return _dense(out, ["nth"], "piece").select("piece", "name", "length", "opens", "closers")


def _dense(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Numbers rows from 0 in the order of columns `by`, which tell them apart: dealt by range, counted by partition, numbered
    within; no task has more than its part. Stored, so that the parts stay what they are."""
    rows = stored(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    ends = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ends = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return rows.withColumn("_nth", within).join(F.broadcast(ends), "_part").withColumn(name, F.col("_start") + F.col("_nth") - 1).drop("_part", "_nth", "_start")


def clade_nodes(pieces: DataFrame) -> DataFrame:
    """(start, end, rank, length, height, last_height): the inner nodes of read_tree()'s pieces: the first and the last tip under
    each, its place among the brackets that open before its first tip (from 0, outermost first), the length of its branch, and
    its height over the first and over the last tip.

    The k-th bracket to open, by depth and then place, closes with the k-th to close in the same order, as brackets of one depth
    take turns. A height is the sum of branches down to a tip; those over the first tip all open with it, those over the last
    close with it."""
    pieces = stored(pieces, "pieces")
    sums = running_sums(pieces.select("piece", F.col("opens").cast("long").alias("o"), F.size("closers").cast("long").alias("c")), "piece", ["o", "c"])
    depth = sums.select("piece", (F.col("run_o") - F.col("run_c") - F.col("o") + F.col("c")).alias("before"), F.col("o"))
    total = sums.agg(F.coalesce(F.sum("o"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.min(F.col("run_o") - F.col("run_c"))).first()
    if total[0] != total[1] or (total[2] or 0) < 0:
        raise FormatError("unbalanced brackets in the tree")
    rows = pieces.join(depth, "piece")
    opened = rows.filter("opens > 0").select("piece", "length", F.col("before"), F.explode(F.sequence(F.lit(0), F.col("opens") - 1)).alias("rank"))
    opened = opened.select((F.col("before") + F.col("rank")).alias("depth"), F.col("piece").alias("start"), "rank", F.col("length").alias("tip"))
    at = F.posexplode("closers").alias("nth", "branch")
    closed = rows.filter(F.size("closers") > 0).select("piece", F.col("length").alias("tip_2"), (F.col("before") + F.col("opens") - 1).alias("top"), "closers", at)
    inner = F.aggregate(F.slice("closers", 1, F.col("nth")), F.col("tip_2"), lambda a, x: a + x)
    closed = closed.select((F.col("top") - F.col("nth")).alias("depth"), F.col("piece").alias("end"), F.col("branch").alias("length"), inner.alias("last_height"))
    nodes = _dense(opened, ["depth", "start"], "k").drop("depth").join(_dense(closed, ["depth", "end"], "k").drop("depth"), "k")
    # of the brackets that open with one tip the outer ones' heights are the inner ones' branches, added up
    inward = Window.partitionBy("start").orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("height", F.col("tip") + F.coalesce(F.sum("length").over(inward), F.lit(0.0))).select("start", "end", "rank", "length", "height", "last_height")


def cut(pieces: DataFrame, height: float, tolerance: float = 1e-6) -> DataFrame:
    """(name, clade): the largest subtrees whose tips are within height of each other, numbered from 1 in order of the tips. Only
    for ultrametric trees: the heights over a node's first and last tip must agree."""
    pieces = stored(pieces, "pieces")
    nodes = stored(clade_nodes(pieces), "nodes")
    off = F.abs(F.col("height") - F.col("last_height")) > tolerance * F.greatest(F.lit(1.0), F.col("height"), F.col("last_height"))
    if not nodes.filter(off).isEmpty():
        raise FormatError("the tree isn't ultrametric")
    low = nodes.filter(2 * F.col("height") <= height + 1e-12).groupBy("start").agg(F.max("end").alias("end"))
    steps = low.select(F.col("start").alias("piece"), F.lit(1).cast("long").alias("up"), F.lit(0).cast("long").alias("down")).union(low.select("end", F.lit(0).cast("long"), F.lit(1).cast("long")))
    steps = steps.groupBy("piece").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    rows = pieces.select("piece", "name").join(steps, "piece", "left").na.fill(0, ["up", "down"])
    # subtrees open at a tip, those that begin with it not counted: none, so the tip begins a clade
    held = running_sums(rows, "piece", ["up", "down"]).withColumn("open", F.col("run_up") - F.col("up") - F.col("run_down") + F.col("down"))
    first = held.select("piece", "name", (F.col("open") == 0).cast("long").alias("first"))
    return running_sums(first, "piece", ["first"]).select("name", F.col("run_first").alias("clade"))


def tree_of(merges: DataFrame, names: DataFrame) -> DataFrame:
    """read_tree()'s columns of the whole tree of linkage()'s merges; names: (asv_ord, name) of all tips.

    A cluster's tips stand together, those of the left before those of the right, so that a tip that leads a right cluster stands
    as many places after the left one's leader as that had tips. Places are sums of these steps up to the first tip, by pointer
    doubling. A branch is half the difference of the heights of a merge and of the merge before it in the same cluster."""
    merges = stored(merges, "merges")
    turn = Window.partitionBy("left").orderBy("size")
    led = merges.withColumn("before", F.coalesce(F.lag("size").over(turn), F.lit(1))).withColumn("below", F.coalesce(F.lag("height").over(turn), F.lit(0.0)))
    led = stored(led.withColumn("nth", F.row_number().over(turn)), "led")
    place = names.select("asv_ord").join(led.select(F.col("right").alias("asv_ord"), F.col("left").alias("up"), F.col("before").alias("step")), "asv_ord", "left")
    place = stored(place.select("asv_ord", "up", F.coalesce("step", F.lit(0)).cast("long").alias("step")), "places")
    roots = place.filter("up is null").limit(2).count()
    if roots > 1:
        raise ValueError("the merges don't join all tips; cluster without a height")
    while not place.filter("up is not null").isEmpty():
        far = place.select(F.col("asv_ord").alias("up"), F.col("up").alias("up_2"), F.col("step").alias("step_2"))
        place = stored(place.join(far, "up", "left").select("asv_ord", F.col("up_2").alias("up"), (F.col("step") + F.coalesce("step_2", F.lit(0))).alias("step")), "places")
    place = place.select("asv_ord", F.col("step").alias("piece"))
    # the branch over each node: to the merge that its cluster goes into next, as left or as right
    nxt = led.select(F.col("left").alias("c"), (F.col("nth") - 1).alias("own"), F.col("height").alias("over"))
    last = led.groupBy("left").agg(F.max("nth").alias("n"))
    right = led.select(F.col("right").alias("c"), F.col("height").alias("over")).join(last.withColumnRenamed("left", "c"), "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("own"), "over")
    over = nxt.union(right)
    node = led.select(F.col("left").alias("c"), F.col("nth").alias("own"), "height", "size").join(over, ["c", "own"], "left")
    node = node.join(place.withColumnRenamed("asv_ord", "c"), "c").select((F.col("piece") + F.col("size") - 1).alias("piece"), "size", F.coalesce((F.col("over") - F.col("height")) / 2, F.lit(0.0)).alias("branch"))
    closers = node.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("size", "branch"))), lambda x: x["branch"]).alias("closers"))
    tips = names.join(place, "asv_ord").join(over.filter("own = 0").select(F.col("c").alias("asv_ord"), F.col("over").alias("tip")), "asv_ord", "left")
    tips = tips.join(last.select(F.col("left").alias("asv_ord"), F.col("n").alias("opens")), "asv_ord", "left").join(closers, "piece", "left")
    return tips.select("piece", "name", (F.coalesce("tip", F.lit(0.0)) / 2).alias("length"), F.coalesce("opens", F.lit(0)).cast("int").alias("opens"), F.coalesce("closers", F.array().cast("array<double>")).alias("closers"))


def newick_lines(pieces: DataFrame) -> DataFrame:
    """(value): a line for each tip, in order; end to end the lines are the tree's Newick text."""
    last = pieces.agg(F.max("piece").alias("last"))  # one row
    name = F.when(F.col("name").rlike(r"[\s:;]"), F.concat(F.lit("'"), "name", F.lit("'"))).otherwise(F.col("name"))
    number = lambda x: F.format_string("%.17g", x)
    close = F.concat_ws("", F.transform("closers", lambda x, i: F.when((F.col("piece") == F.col("last")) & (i == F.size("closers") - 1), F.lit(")")).otherwise(F.concat(F.lit("):"), number(x)))))
    line = F.concat(F.repeat(F.lit("("), F.col("opens")), name, F.lit(":"), number(F.col("length")), close, F.when(F.col("piece") == F.col("last"), F.lit(";")).otherwise(F.lit(",")))
    return pieces.crossJoin(F.broadcast(last)).orderBy("piece").select(line.alias("value"))
