import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqsieve.operators import linkage, trees
from seqsieve.sources.files import FormatError


def parse(text):
    """A tree as nested [name, length, children], the plain way."""
    text, at = re.sub(r"\s*([(),:;])\s*", r"\1", text.strip()), 0

    def node():
        nonlocal at
        children = []
        if text[at] == "(":
            while text[at] in "(,":
                at += 1
                children.append(node())
            at += 1
        end = at
        while text[end] not in ",();":
            end += 1
        name, _, length = text[at:end].partition(":")
        at = end
        return [name.strip().strip("'"), float(length or 0), children]

    return node()


def brute_cut(tree, height):
    """Tips of the largest subtrees whose height, doubled, is within."""

    def tall(n):
        return max((tall(k) + k[1] for k in n[2]), default=0.0)

    def tips(n):
        return [t for k in n[2] for t in tips(k)] if n[2] else [n[0]]

    def parts(n):
        return [tips(n)] if 2 * tall(n) <= height + 1e-12 else [p for k in n[2] for p in parts(k)]

    return parts(tree)


def random_tree(rnd, names, top):
    """Ultrametric, with forks of two to four branches."""
    if len(names) == 1:
        return f"{names[0]}:{top!r}"
    k = min(len(names), rnd.randint(2, 4))
    cuts = sorted(rnd.sample(range(1, len(names)), k - 1))
    low = top * rnd.uniform(0.3, 0.9)
    return "(" + ",".join(random_tree(rnd, names[a:b], low) for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True)) + f"):{top - low!r}"


@pytest.mark.parametrize("text", ["((a:0.1,b:0.1):0.2,(c:0.05,'d e':0.05):0.25);", "(a:1,b:1,c:1,d:1);", "a;", "( a:1.0e-1 ,\n(b:0.05,c:0.05)x1:0.05 )root;"])
def test_cut_by_hand(spark, tmp_path, text):
    (tmp_path / "t.nwk").write_text(text)
    pieces = trees.read_tree(spark, str(tmp_path / "t.nwk"))
    for height in (0.1, 0.15, 0.6):
        got = sorted(map(tuple, trees.cut(pieces, height).collect()), key=lambda r: r[1])
        want = [(name, i + 1) for i, part in enumerate(brute_cut(parse(text), height)) for name in part]
        assert sorted(got) == sorted(want)


def test_random_trees(spark, tmp_path):
    rnd = random.Random(3)
    names = [f"t{i}" for i in range(400)]
    text = random_tree(rnd, names, 1.0).rpartition(":")[0] + ";"
    (tmp_path / "t.nwk").write_text(text)
    pieces = trees.read_tree(spark, str(tmp_path / "t.nwk"))
    for height in (0.3,):
        got = {}
        for r in trees.cut(pieces, height).collect():
            got.setdefault(r.clade, []).append(r.name)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute_cut(parse(text), height)))


@pytest.mark.parametrize("text,error", [("((a:1,b:1);", FormatError), ("(a:1,b:1));", FormatError), ("((a:1,b:3):1,c:2);", FormatError), ("(a:1,'b", PySparkException)])
def test_bad_trees(spark, tmp_path, text, error):
    (tmp_path / "t.nwk").write_text(text)
    with pytest.raises(error):
        trees.cut(trees.read_tree(spark, str(tmp_path / "t.nwk")), 0.1).collect()


def test_tree_of_merges_and_back(spark, tmp_path):
    rnd = random.Random(5)
    base, rows = "".join(rnd.choices("ACGT", k=150)), []
    for i in range(30):
        s = list(rnd.choice(rows)[1] if rows else base)
        for at in rnd.sample(range(150), rnd.randint(1, 12)):
            s[at] = rnd.choice("ACGT")
        rows.append((i, "".join(s)))
    rows.append((30, rows[4][1]))
    df = spark.createDataFrame(rows, "asv_ord long, seq string").repartition(2)
    label, merges = linkage.linkage(df, float("inf"))
    assert label.select("clade").distinct().count() == 1 and merges.count() == 30
    pieces = trees.tree_of(merges, df.select("asv_ord", F.concat(F.lit("s "), F.col("asv_ord").cast("string")).alias("name")))
    trees.newick_lines(pieces).write.text(str(tmp_path / "tree"))
    again = trees.read_tree(spark, str(tmp_path / "tree"))
    text = "".join(r.value for r in trees.newick_lines(pieces).collect())
    for height in (0.1,):
        want = {}
        for r in linkage.linkage(df, height)[0].collect():
            want.setdefault(r.clade, []).append(f"s {r.asv_ord}")
        got = {}
        for r in trees.cut(again, height).collect():
            got.setdefault(r.clade, []).append(r.name)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) == sorted(map(sorted, brute_cut(parse(text), height)))
    with pytest.raises(ValueError, match="don't join"):
        trees.tree_of(linkage.linkage(df, 0.01)[1], df.select("asv_ord", F.col("asv_ord").cast("string").alias("name")))


def test_linkage_order():
    """Row minima that are kept give what searching all gives."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.random((25, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        label, merges = linkage.average_linkage(d, 0.6)
        groups = [[i] for i in range(25)]
        for m in merges:
            best = min((d[np.ix_(a, b)].mean(), a[0], b[0]) for i, a in enumerate(groups) for b in groups[i + 1 :])
            assert best[0] == pytest.approx(m[2])
            a, b = (next(g for g in groups if g[0] == k) for k in m[:2])
            groups = sorted([sorted(a + b), *(g for g in groups if g is not a and g is not b)])
        assert all(label[i] == g[0] for g in groups for i in g)


def test_whole_tree_goes_on_from_components(spark):
    """More sequences than a task takes: first by components, then by sums over clusters. The tree is the same; copies join one by one."""
    rnd, rows = random.Random(8), []
    for _ in range(3):
        base = "".join(rnd.choices("ACGT", k=150))
        for _ in range(7):
            s = list(base)
            for at in rnd.sample(range(150), rnd.randint(1, 9)):
                s[at] = rnd.choice("ACGT")
            rows.append((len(rows), "".join(s)))
    rows += [(len(rows) + i, rows[3][1]) for i in range(2)]
    df = spark.createDataFrame(rows, "asv_ord long, seq string").repartition(2)
    trees_of = [sorted((r.left, r.right, r["size"], round(r.height, 9)) for r in linkage.linkage(df, float("inf"), in_task=n)[1].collect()) for n in (100, 10)]
    assert len(trees_of[0]) == len(rows) - 1 and trees_of[0] == trees_of[1]
    assert [m for m in trees_of[1] if m[1] in (21, 22)] == [(3, 21, 2, 0.0), (3, 22, 3, 0.0)]
