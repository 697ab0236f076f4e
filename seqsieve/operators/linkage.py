"""Average-linkage clusters up to a height: small components in tasks, large ones by rounds of reciprocal nearest neighbours
(H-3 to H-5, R3), and the merges as a table (K-6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clades as c
from .rounds import stored

MERGES = "left long, right long, height double, size long"
#: Height up to which a whole tree is made by components first; clusters left then that are merged in one task, at most.
FIRST, LEFT_IN_TASK = 0.2, 2048


class Halves:
    """A symmetric matrix of n rows of which only the part over the diagonal is kept, row after row."""

    def __init__(self, n: int):
        i = np.arange(n, dtype=np.int64)
        self.n, self.start = n, i * n - i * (i + 1) // 2 - i - 1
        self.kept = np.empty(n * (n - 1) // 2)

    def row(self, i: int) -> np.ndarray:
        out = np.empty(self.n)
        out[:i], out[i], out[i + 1 :] = self.kept[self.start[:i] + i], np.inf, self.kept[self.start[i] + i + 1 : self.start[i] + self.n]
        return out

    def put(self, i: int, row: np.ndarray) -> None:
        self.kept[self.start[:i] + i] = row[:i]
        self.kept[self.start[i] + i + 1 : self.start[i] + self.n] = row[i + 1 :]


def average_linkage(d: np.ndarray | Iterator[np.ndarray], height: float, size: np.ndarray | None = None, n: int | None = None) -> tuple[np.ndarray, list[tuple[int, int, float, int]]]:
    """Cluster numbers of average linkage, by first member, merging while the nearest two are within height, and the merges (left,
    right, height, size of both), left < right first members. d: distances, a matrix or slabs of rows of one with n rows; half of
    it is kept. size: weights of the members. Of equally near pairs the first merges. Row minima are kept, so a merge reads a row
    or few."""
    if n is None:
        n, d = len(d), iter([np.asarray(d, float)])
    size = np.ones(n, np.int64) if size is None else size.astype(np.int64).copy()
    label, merges, half = np.arange(n), [], Halves(n)
    near, least, at = np.zeros(n, int), np.full(n, np.inf), 0
    for slab in d if n else ():
        slab = slab.astype(float)
        own = np.arange(at, at + len(slab))
        slab[own - at, own] = np.inf
        near[own] = slab.argmin(axis=1)
        least[own] = slab[own - at, near[own]]
        for i in own.tolist():
            half.kept[half.start[i] + i + 1 : half.start[i] + n] = slab[i - at, i + 1 :]
        at += len(slab)
    while n > 1:
        i = int(least.argmin())
        if not least[i] <= height or np.isinf(least[i]):
            break
        i, j = sorted((i, int(near[i])))
        own, other = half.row(i), half.row(j)
        merges.append((i, j, float(own[j]), int(size[i] + size[j])))
        merged = (own * size[i] + other * size[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        half.put(i, merged)
        half.put(j, np.full(n, np.inf))
        size[i] += size[j]
        label[label == j] = i
        stale = np.flatnonzero((near == i) | (near == j))
        for k in np.unique(np.r_[stale, i, j]).tolist():
            if k != j and np.isinf(least[k]) and k != i:
                continue  # merged before: no row is near
            row = half.row(k)
            near[k] = row.argmin()
            least[k] = row[near[k]]
        # the merged row may be as near as before or nearer to others
        closer = np.flatnonzero((merged < least) | ((merged == least) & (i < near) & np.isfinite(merged)))
        near[closer], least[closer] = i, merged[closer]
    return label, merges


def _greatest(aligned: DataFrame, model: str, freq: dict[str, float]) -> float:
    """What undefined distances count as: the greatest of all, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = -np.inf
        for row in (r for batch in batches for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
            (x, p, _), (y, q, _) = c._opened(row["tile"]), c._opened(row["other"])
            for at in range(0, len(x), 64):
                d = c.tile_distances(p[at : at + 64], q, (model,), freq)[0]
                d = d[(x[at : at + 64, None] != y[None]) & ~np.isnan(d)]
                top = max(top, d.max(initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array([top if np.isfinite(top) else None], pa.float64())], names=["d"])

    top = c.all_tiles(aligned).select("tile", "other").mapInArrow(run, "d double").agg(F.max("d")).first()[0]
    return float(np.ceil(top or 0.0))


def linkage(aligned: DataFrame, height: float = 0.2, model: str = "F84", in_task: int = 12_288) -> tuple[DataFrame, DataFrame]:
    """((asv_ord, clade), merges): the clusters of the average-linkage tree cut at height, a clade's number its first member's; and
    the tree's merges up to there (left, right, height, size of both), a cluster's number its first member's, children's heights
    at most their parents'. An infinite height gives the whole tree: up to FIRST by components, as for that height; what is left,
    by the sums of distances of all pairs of clusters, which are added up as the sequences are compared.

    Equal sequences are one, weighted, from the start. Clusters can't reach over components of the graph of pairs within the
    height; components of up to `in_task` distinct sequences are clustered in a task each, which keeps half of their distances
    (600 MB for the 12,288). They are found by links that are fewer than the sequences of a task, not by pairs. Larger ones, of any size, are merged in
    rounds: rows hold two clusters, the sum of their members' distances and their number; clusters that are each other's nearest
    merge (average linkage gives the same tree in any such order), and rows are relabelled and added up. Rows are kept for
    clusters with members within the height only; where a merge needs the sum of two others, it is made from the sequences. Of
    equally near pairs the one of the least numbers merges first; where it matters, ties may fall otherwise than in a task.
    Undefined distances count as the greatest of all, rounded up; it is looked for only if there are any. No rows: no clusters."""
    if model == "BH87":
        raise ValueError("BH87 isn't the same both ways, so there are no clusters by it")
    rows = aligned.select("asv_ord", F.upper("seq").alias("seq"))
    freq = c.frequencies(rows)
    bare = ~F.col("seq").rlike("[ACGT]")  # no distance to themselves
    same = stored(rows.withColumn("_own", F.when(bare, F.col("asv_ord"))).groupBy("seq", "_own").agg(F.min("asv_ord").alias("c"), F.count("*").alias("size")).select(F.col("c").alias("asv_ord"), "seq", "size"), "distinct")
    first = rows.withColumn("_own", F.when(bare, F.col("asv_ord")).otherwise(F.lit(-1))).select("asv_ord", "seq", "_own")
    keyed = same.select(F.col("asv_ord").alias("c"), "seq", F.when(bare, F.col("asv_ord")).otherwise(F.lit(-1)).alias("_own"))
    member = first.join(keyed, ["seq", "_own"]).select("asv_ord", "c")
    odd: list[float] = []

    def undefined() -> float:
        if not odd:
            odd.append(_greatest(same, model, freq))
        return odd[0]

    if np.isfinite(height) or same.count() <= in_task:
        label, merges = _flat(same, height, model, freq, undefined, in_task)
    else:
        label, merges = _whole(same, model, freq, undefined, in_task)
    # copies join the first one by one
    nth = F.row_number().over(Window.partitionBy("c").orderBy("asv_ord")).cast("long")
    copies = member.filter("asv_ord != c").select(F.col("c").alias("left"), F.col("asv_ord").alias("right"), F.lit(0.0).alias("height"), (nth + 1).alias("size"))
    return member.join(label.withColumnRenamed("asv_ord", "c"), "c").select("asv_ord", "clade"), merges.union(copies)


def _flat(same: DataFrame, height: float, model: str, freq: dict[str, float], undefined, in_task: int) -> tuple[DataFrame, DataFrame]:
    """Clusters and merges up to a height of distinct sequences (asv_ord, seq, size); an infinite one: of up to in_task."""
    if np.isfinite(height):
        parts = c.connected(same, stored(c.near_links(same, height, model, freq=freq), "near"))
    else:  # all hang together
        parts = same.select("asv_ord", F.lit(0).cast("long").alias("component"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    parts = stored(parts.join(sizes, "component"), "parts")
    small = same.join(parts.filter(F.col("n") <= in_task), "asv_ord")
    label, merges = _in_tasks(small, height, model, freq, undefined)
    large = same.join(parts.filter(F.col("n") > in_task).select("asv_ord"), "asv_ord")
    if not large.isEmpty():
        large = stored(large, "large")
        more, others = _in_rounds(large, stored(c.near_pairs(large, height, model, freq=freq), "near"), height, model, freq, undefined)
        label, merges = label.union(more), merges.union(others)
    return label, merges


def _whole(same: DataFrame, model: str, freq: dict[str, float], undefined, in_task: int) -> tuple[DataFrame, DataFrame]:
    """The whole tree of distinct sequences (asv_ord, seq, size). Merges up to FIRST come before all others, and average linkage goes
    on from the clusters that they leave by their sums of distances alone."""
    label, merges = _flat(same, FIRST, model, freq, undefined, in_task)
    label = stored(label, "first")
    member = label.withColumnRenamed("clade", "c")
    weight = stored(member.join(same.select("asv_ord", "size"), "asv_ord").groupBy("c").agg(F.sum("size").alias("size")), "weights")
    links = stored(_all_sums(same, member, model, freq), "links")
    if weight.count() > LEFT_IN_TASK or in_task == 0:
        label, others = _rounds(same, stored(member, "members"), weight, links, float("inf"), model, freq, undefined)
        return label, merges.union(others)
    top = 0.0 if links.filter("u > 0").isEmpty() else undefined()
    size = {r.c: r["size"] for r in weight.collect()}  # LEFT_IN_TASK rows at most

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        ords = np.array(sorted(size))
        d = np.full((len(ords), len(ords)), np.inf)
        i, j = (np.searchsorted(ords, frame[k].to_numpy()) for k in "ab")
        d[i, j] = d[j, i] = ((frame["s"] + frame["u"] * top) / frame["n"]).to_numpy()
        found = average_linkage(d, float("inf"), np.array([size[o] for o in ords.tolist()]))[1]
        return pd.DataFrame({"left": [ords[m[0]] for m in found], "right": [ords[m[1]] for m in found], "height": [m[2] for m in found], "size": [m[3] for m in found]})

    others = stored(links.groupBy(F.lit(0).alias("one")).applyInPandas(cluster, MERGES), "last")
    return label.select("asv_ord", F.lit(min(size)).cast("long").alias("clade")), merges.union(others)


def _all_sums(same: DataFrame, member: DataFrame, model: str, freq: dict[str, float]) -> DataFrame:
    """(a, b, s, u, n), a < b, for all pairs of clusters (member: asv_ord, c) what _sums() gives: tiles of sequences are compared, and
    what belongs to one pair of clusters is added up there."""
    many = max(1, -(-same.count() // c.BLOCK))
    rows = same.join(member, "asv_ord").withColumn("i", F.pmod(F.xxhash64("asv_ord"), F.lit(many)))
    weights = rows.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("asv_ord", "c", "size"))).alias("of"))  # as many as a tile has
    cut = c.tiles(rows, ["i"]).join(weights, "i").select("i", F.struct("tile", "of").alias("tile"))
    both = c._pairs_of(stored(cut, "cut"), many)

    def part(side) -> tuple[np.ndarray, ...]:
        """Planes, weights, clusters and where each cluster's rows begin, of a tile's rows in order of their clusters."""
        _, planes, _ = c._opened(side["tile"])
        own, size = (np.array([x[k] for x in side["of"]]) for k in ("c", "size"))
        by = np.argsort(own, kind="stable")
        names, starts = np.unique(own[by], return_index=True)
        return planes[by], size[by].astype(float), names, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
            (p, w, x, from_x), (q, v, y, from_y) = part(row["tile"]), part(row["other"])
            s, u = np.empty((len(p), len(y))), np.empty((len(p), len(y)))
            for at in range(0, len(p), 64):
                d = c.tile_distances(p[at : at + 64], q, (model,), freq)[0]
                none = np.isnan(d)
                s[at : at + 64] = np.add.reduceat(np.where(none, 0.0, d) * v, from_y, axis=1)
                u[at : at + 64] = np.add.reduceat(none * v, from_y, axis=1)
            s, u = (np.add.reduceat(k * w[:, None], from_x, axis=0) for k in (s, u))
            n = np.add.reduceat(w, from_x)[:, None] * np.add.reduceat(v, from_y)[None]
            i, j = np.nonzero(x[:, None] < y[None] if row["same"] else x[:, None] != y[None])
            a, b = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
            for k in range(0, len(a), 1 << 16):
                to = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(z[to]) for z in (a, b, s[i, j], u[i, j].astype(np.int64), n[i, j].astype(np.int64))], names=["a", "b", "s", "u", "n"])

    rows = both.select("same", "tile", "other").mapInArrow(run, "a long, b long, s double, u long, n long")
    return rows.groupBy("a", "b").agg(*(F.sum(k).alias(k) for k in "sun"))


def _in_tasks(rows: DataFrame, height: float, model: str, freq: dict[str, float], undefined) -> tuple[DataFrame, DataFrame]:
    """Components (component, asv_ord, seq, size) clustered in a task each; those with undefined distances once more, when it is
    known what these count as."""

    def clustered(some: DataFrame, top: float | None) -> DataFrame:
        def cluster(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("asv_ord", ignore_index=True)
            ords, x = frame["asv_ord"].to_numpy(), c.packed(c._codes(frame["seq"].tolist()))
            odd = False

            def slabs() -> Iterator[np.ndarray]:
                nonlocal odd
                for i in range(0, len(x), 64):
                    d = c.tile_distances(x[i : i + 64], x, (model,), freq)[0]
                    np.fill_diagonal(d[:, i:], 0.0)
                    if (none := np.isnan(d)).any():
                        odd, d = True, np.where(none, np.inf if top is None else top, d)
                    yield d

            label, merges = average_linkage(slabs(), height, frame["size"].to_numpy(), len(x))
            if odd and top is None:
                return pd.DataFrame({"asv_ord": ords, "clade": frame["component"], "left": 0, "right": 0, "height": 0.0, "size": -1})
            own = pd.DataFrame({"asv_ord": ords, "clade": ords[label], "left": 0, "right": 0, "height": 0.0, "size": 0})
            i, j = ([ords[m[k]] for m in merges] for k in (0, 1))
            made = pd.DataFrame({"asv_ord": -1, "clade": -1, "left": i, "right": j, "height": [m[2] for m in merges], "size": [m[3] for m in merges]})
            return pd.concat([own, made]) if merges else own

        return stored(some.groupBy("component").applyInPandas(cluster, "asv_ord long, clade long, " + MERGES), "small")

    found = clustered(rows, None)
    odd = found.filter("size = -1")
    if not odd.isEmpty():
        again = clustered(rows.join(odd.select(F.col("clade").alias("component")).distinct(), "component", "left_semi"), undefined())
        found = found.filter("size >= 0").union(again)
    return found.filter("size = 0").select("asv_ord", "clade"), found.filter("size > 0").select("left", "right", "height", "size")


def _sums(wanted: DataFrame, member: DataFrame, rows: DataFrame, model: str, freq: dict[str, float]) -> DataFrame:
    """(x, y, s, u, n): of pairs of clusters (x, y) the sum of their members' defined distances, the number of undefined ones, and
    of all. Clusters are packed as tiles of up to some BLOCK sequences, and tiles compared."""
    ends = wanted.select(F.col("x").alias("c")).union(wanted.select(F.col("y").alias("c"))).distinct()
    own = member.join(ends, "c", "left_semi").join(rows, "asv_ord")
    blocks = own.groupBy("c").agg(F.ceil(F.count("*") / c.BLOCK).alias("blocks"))
    own = own.join(blocks, "c").withColumn("t", F.pmod(F.xxhash64("asv_ord"), F.col("blocks")))
    weights = own.groupBy("c", "t").agg(F.map_from_entries(F.collect_list(F.struct("asv_ord", "size"))).alias("sizes"))
    cut = c.tiles(own.select("c", "t", "asv_ord", "seq"), ["c", "t"]).join(weights, ["c", "t"])
    both = wanted.join(cut.select(F.col("c").alias("x"), F.col("t").alias("t_x"), "tile", "sizes"), "x").join(cut.select(F.col("c").alias("y"), F.col("t").alias("t_y"), F.col("tile").alias("other"), F.col("sizes").alias("others")), "y").repartition("x", "y", "t_x", "t_y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, tile, other, sizes, others in zip(batch["x"], batch["y"], batch["tile"], batch["other"], batch["sizes"], batch["others"], strict=True):
                (ox, p, _), (oy, q, _) = c._opened(tile), c._opened(other)
                sizes, others = dict(sizes), dict(others)
                w, v = np.array([sizes[o] for o in ox], float), np.array([others[o] for o in oy], float)
                s = u = 0.0
                for at in range(0, len(ox), 64):
                    d, k = c.tile_distances(p[at : at + 64], q, (model,), freq)[0], np.outer(w[at : at + 64], v)
                    none = np.isnan(d)
                    s, u = s + float((np.where(none, 0.0, d) * k).sum()), u + float(k[none].sum())
                out.append((x, y, s, int(u), int(w.sum() * v.sum())))
            yield pd.DataFrame(out, columns=["x", "y", "s", "u", "n"])

    return both.select("x", "y", "tile", "other", "sizes", "others").mapInPandas(run, "x long, y long, s double, u long, n long").groupBy("x", "y").agg(*(F.sum(k).alias(k) for k in "sun"))


def _in_rounds(rows: DataFrame, edges: DataFrame, height: float, model: str, freq: dict[str, float], undefined) -> tuple[DataFrame, DataFrame]:
    """Large components (asv_ord, seq, size), with the pairs within the height (a, b, d), merged round by round."""
    weight = rows.select(F.col("asv_ord").alias("c"), "size")
    member = stored(rows.select("asv_ord", F.col("asv_ord").alias("c")), "members")
    n = F.col("w_a") * F.col("w_b")
    links = edges.join(weight.select(F.col("c").alias("a"), F.col("size").alias("w_a")), "a").join(weight.select(F.col("c").alias("b"), F.col("size").alias("w_b")), "b")
    none = F.isnan("d")
    links = stored(links.select("a", "b", F.when(none, 0.0).otherwise(F.col("d") * n).alias("s"), F.when(none, n).otherwise(0).cast("long").alias("u"), n.alias("n")), "links")
    return _rounds(rows, member, stored(weight, "weights"), links, height, model, freq, undefined)


def _rounds(rows: DataFrame, member: DataFrame, weight: DataFrame, links: DataFrame, height: float, model: str, freq: dict[str, float], undefined) -> tuple[DataFrame, DataFrame]:
    """Merges round by round from clusters: their members (asv_ord, c), sizes (c, size) and links (a, b, s, u, n), a < b; all stored."""
    made, n = None, F.col("w_a") * F.col("w_b")
    while True:
        top = 0.0 if links.filter("u > 0").isEmpty() else undefined()
        mean: Column = (F.col("s") + F.col("u") * top) / F.col("n")
        near = links.select("a", "b", mean.alias("d")).filter(F.col("d") <= F.lit(height))
        edge = F.struct("d", "a", "b").alias("edge")
        best = near.select(F.col("a").alias("c"), edge).union(near.select(F.col("b").alias("c"), edge)).groupBy("c").agg(F.min("edge").alias("edge"))
        pairs = best.groupBy("edge").agg(F.count("*").alias("ends")).filter("ends = 2").select("edge.a", "edge.b", "edge.d")  # each other's nearest
        pairs = stored(pairs.join(weight.withColumnsRenamed({"c": "a", "size": "w_a"}), "a").join(weight.withColumnsRenamed({"c": "b", "size": "w_b"}), "b").select("a", "b", "d", (F.col("w_a") + F.col("w_b")).alias("size")), "merges")
        if pairs.isEmpty():
            break
        turn = pairs.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), "size")
        made = turn if made is None else made.union(turn)
        moved = pairs.select(F.col("b").alias("was"), F.col("a").alias("now"))
        new = lambda df, k: df.join(moved.withColumnsRenamed({"was": k, "now": f"{k}_now"}), k, "left").withColumn(f"{k}_new", F.coalesce(f"{k}_now", k)).drop(f"{k}_now")  # noqa: B023, E731
        before, member = member, stored(new(member, "c").select("asv_ord", F.col("c_new").alias("c")), "members")
        grown = stored(weight.join(moved.select(F.col("was").alias("c")), "c", "left_anti").join(pairs.select(F.col("a").alias("c"), F.col("size").alias("both")), "c", "left").select("c", F.coalesce("both", "size").alias("size")), "weights")
        told = new(new(links, "a"), "b").filter("a_new != b_new").select("a", "b", F.least("a_new", "b_new").alias("x"), F.greatest("a_new", "b_new").alias("y"), "s", "u", "n")
        told = stored(told, "relabelled")
        sums = told.groupBy("x", "y").agg(*(F.sum(k).alias(k) for k in "sun"))
        whole = sums.join(grown.withColumnsRenamed({"c": "x", "size": "w_a"}), "x").join(grown.withColumnsRenamed({"c": "y", "size": "w_b"}), "y")
        short = whole.filter(n > F.col("n")).select("x", "y")
        # the halves of both that no row has
        halves = grown.select(F.col("c").alias("now"), F.col("c").alias("was")).union(moved.select("now", "was"))
        every = short.join(halves.withColumnsRenamed({"now": "x", "was": "p"}), "x").join(halves.withColumnsRenamed({"now": "y", "was": "q"}), "y")
        lacking = every.select("x", "y", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).join(told.select("a", "b"), ["a", "b"], "left_anti")
        lacking = stored(lacking, "lacking")
        if not lacking.isEmpty():
            made_up = _sums(lacking.select(F.col("a").alias("x"), F.col("b").alias("y")), before, rows, model, freq).withColumnsRenamed({"x": "a", "y": "b"})
            sums = told.select("x", "y", "s", "u", "n").union(lacking.join(made_up, ["a", "b"]).select("x", "y", "s", "u", "n")).groupBy("x", "y").agg(*(F.sum(k).alias(k) for k in "sun"))
        links = stored(sums.select(F.col("x").alias("a"), F.col("y").alias("b"), "s", "u", "n"), "links")
        weight = grown
    label = member.select("asv_ord", F.col("c").alias("clade"))
    return label, made if made is not None else label.sparkSession.createDataFrame([], MERGES)
