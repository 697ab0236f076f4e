import random
import re

import numpy as np
import pytest

from seqsieve.operators import clades, linkage


def test_components_cut_alike():
    """Clustering each component of the graph within the height gives what clustering everything gives."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.random((14, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        whole = linkage.average_linkage(d, 0.25)[0]
        part = np.arange(14)
        while True:
            new = np.array([part[d[i] <= 0.25].min() for i in range(14)])
            if (new == part).all():
                break
            part = new
        split = np.full(14, -1)
        for c in np.unique(part):
            own = np.flatnonzero(part == c)
            split[own] = own[linkage.average_linkage(d[np.ix_(own, own)], 0.25)[0]]
        assert (whole == split).all()


def mutate(rnd, seq, n):
    s = list(seq)
    for i in rnd.sample(range(len(s)), n):
        s[i] = rnd.choice("ACGT")
    return "".join(s)


def test_clades_of_families(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choices("ACGT", k=120)) for _ in range(3)]
    rows = [(i, mutate(rnd, base[i % 3], 4)) for i in range(18)]
    df = spark.createDataFrame(rows, "asv_ord long, seq string")
    label, merges = linkage.linkage(df, 0.2)
    assert {r.asv_ord: r.clade for r in label.collect()} == {i: i % 3 for i in range(18)}
    assert merges.count() == 15


def brute(rows, height, model, freq):
    """Average linkage the plain way: all distances, the nearest two merge, sums over all pairs."""
    x = clades._codes([s.upper() for _, s in rows])
    d = clades.pair_distances(x, x, model, freq)
    np.fill_diagonal(d, 0)
    d[np.isnan(d)] = np.ceil(np.nanmax(d))
    groups, merges = [[i] for i in range(len(rows))], []
    while len(groups) > 1:
        mean, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if mean > height:
            break
        merges.append((rows[groups[i][0]][0], rows[groups[j][0]][0], round(mean, 9), len(groups[i] + groups[j])))
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    return {rows[k][0]: rows[g[0]][0] for g in groups for k in g}, merges


@pytest.mark.parametrize("in_task,model,height,odd", [(2048, "F84", 0.3, False), (2048, "JC69", 0.05, True), (0, "F84", 0.2, False)])
def test_linkage_is_average_linkage(spark, in_task, model, height, odd):
    rnd = random.Random(8)
    rows, base = [], "".join(rnd.choices("ACGT", k=180))
    for i in range(40 if in_task else 20):  # lines of descent, so that clusters nest and distances rarely tie
        parent = rnd.choice(rows)[1] if rows else base
        seq = mutate(rnd, parent, rnd.randint(1, 25 if model != "JC69" else 6))
        if odd and i % 9 == 4:
            seq = seq[:60] + "-" * 120
        elif odd and i % 9 == 5:
            seq = "-" * 60 + seq[60:]
        rows.append((i * 7 + 1, seq))
    rows += [(1000, rows[3][1].lower()), (2, rows[3][1])]
    df = spark.createDataFrame(rows, "asv_ord long, seq string").repartition(3)
    rows.sort()
    label, merges = linkage.linkage(df, height, model, in_task=in_task)
    want, steps = brute(rows, height, model, clades.frequencies(df))
    assert {r.asv_ord: r.clade for r in label.collect()} == want
    got = sorted(round(r.height, 9) for r in merges.collect())
    assert got == pytest.approx(sorted(m[2] for m in steps), abs=1e-8)
    assert linkage.linkage(df.filter("false"), height, model)[0].collect() == []


@pytest.mark.parametrize("most", [0.01, 0.03])
def test_near_pairs_are_all(spark, most, monkeypatch):
    """Segments find what comparing all finds: with gaps, hot segments of many sequences, and tiles of few."""
    monkeypatch.setattr(clades, "BLOCK", 8)
    rnd = random.Random(9)
    base, rows = "".join(rnd.choices("ACGT", k=200)), []
    for i in range(80):
        seq = base[:100] + mutate(rnd, base[100:], rnd.randint(0, 5)) if i % 2 else mutate(rnd, rnd.choice(rows)[1] if rows else base, rnd.randint(0, 4))
        if i % 7 == 3:
            at = rnd.randrange(150)
            seq = seq[:at] + "-" * rnd.choice((3, 40, 50)) + seq[at:]
            seq = seq[:200]
        rows.append((i, seq))
    df = spark.createDataFrame(rows, "asv_ord long, seq string").repartition(3)
    assert clades.segments_for(200, int(most * 200), 2) is not None
    want = {(r.a, r.b): round(r.d, 12) for r in clades.distances(df, "F84", most).collect()}
    found = [((r.a, r.b), round(r.d, 12)) for r in clades.near_pairs(df, most).collect()]
    assert len(found) == len(want) > 20 and dict(found) == want
    assert clades.near_pairs(df.filter("false"), most, freq=dict.fromkeys("ACGT", 0.25)).collect() == []


def test_pairs_of_blocks(spark):
    for n in (0, 1, 2, 7, 300):
        assert sorted(map(tuple, clades._triangle(spark, n).select("i", "j").collect())) == [(i, j) for i in range(n) for j in range(i, n)]


def test_distances(spark):
    df = spark.createDataFrame([(0, "ACGTACGTAC"), (1, "ACGTACGTAT"), (2, "GCGTACGNA-"), (3, "acgtacgtac")], "asv_ord long, seq string")
    d = {(r.a, r.b): r.d for r in clades.distances(df, "raw", block=2).collect()}
    assert len(d) == 6 and d[(0, 1)] == 0.1 and d[(0, 2)] == pytest.approx(1 / 8) and d[(0, 3)] == 0
    near = {(r.a, r.b) for r in clades.distances(df, "raw", most=0.1, block=3).collect()}
    assert near == {(0, 1), (0, 3), (1, 3)}
    jc = {(r.a, r.b): r.d for r in clades.distances(df, "JC69").collect()}
    assert jc[(0, 1)] == pytest.approx(-0.75 * np.log(1 - 4 / 3 * 0.1))
    with pytest.raises(Exception, match="isn't one of"):
        clades.distances(df, "XX").collect()


def test_models_of_tables_and_gaps(spark):
    rnd = random.Random(12)
    base = "".join(rnd.choices("ACGT", k=130))
    rows = [(i, mutate(rnd, base, 5 * i)) for i in range(5)]
    rows = [(i, s if i % 2 else s[:20] + "-" * i + s[20 + i : 90] + "--N" + s[93:]) for i, s in rows]
    df = spark.createDataFrame(rows[::-1], "asv_ord long, seq string")
    got = {(r.a, r.b): r for r in clades.distances(df, ("logdet", "paralin", "BH87", "indel", "indelblock"), block=2).collect()}
    assert len(got) == 10

    def runs(s):
        return {m.span() for m in re.finditer("-+", s)}

    for (a, b), r in got.items():
        x, y = rows[a][1], rows[b][1]
        f = np.array([[sum(p == u and q == v for p, q in zip(x, y, strict=True)) for v in "ACGT"] for u in "ACGT"], float)
        f /= f.sum()
        assert r.logdet == pytest.approx(-np.log(np.linalg.det(f)) / 4 - np.log(4))
        assert r.paralin == pytest.approx(-np.log(np.linalg.det(f) / np.sqrt(np.prod(f.sum(0)) * np.prod(f.sum(1)))) / 4)
        assert r.BH87 == pytest.approx(-np.log(np.linalg.det(f / f.sum(1, keepdims=True))) / 4)
        assert r.indel == sum((p == "-") != (q == "-") for p, q in zip(x, y, strict=True))
        assert r.indelblock == len(runs(x) ^ runs(y))
    with pytest.raises(ValueError):
        linkage.linkage(df, 0.1, "BH87")


def test_base_frequencies(spark):
    df = spark.createDataFrame([("AAc-",), ("GT",)], "seq string")
    assert {r.base: r.n for r in clades.base_frequencies(df).collect()} == {"A": 2, "C": 1, "G": 1, "T": 1}


def test_distances_by_tables_and_forests():
    """Where all sites are bases distances are looked up, rounded as by Spark's round(): as those computed one by one are. Links of
    a tile hang together what its pairs do."""
    from decimal import ROUND_HALF_UP, Decimal

    rnd = np.random.default_rng(5)
    x = clades.packed(rnd.integers(0, 4, (40, 64)).astype(np.uint8))
    freq = dict(zip("ACGT", (0.2, 0.3, 0.1, 0.4), strict=True))
    for m in ("raw", "N", "F84", "K81", "TN93", "T92", "logdet", "paralin", "BH87"):
        want = clades.table_distances(clades.base_tables(x, x), m) if m in clades.TABLE_MODELS else clades.model_distances(clades.site_counts(x, x), m, freq)
        got = clades.tile_distances(x, x, (m,), freq)[0]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-15, equal_nan=True)
        for a, b in zip(clades.rounded(want, 3).ravel(), want.ravel(), strict=True):
            assert np.isnan(b) if np.isnan(a) else a == float(Decimal(repr(float(b))).quantize(Decimal("0.001"), ROUND_HALF_UP))
    assert clades.rounded(np.array([0.0625, -0.0005, 1.0005, 2.5]), 3).tolist() == [0.063, -0.001, 1.001, 2.5]
    near = rnd.random((30, 20)) < 0.03
    u, v = np.nonzero(near)
    first = clades._stars(near)
    parts = {}
    for a, b in zip(*clades._forest(u, v + 100), strict=True):
        parts[b] = a
    for own, add in zip(first, (0, 100), strict=True):
        for i, root in enumerate(own):
            assert (root < 0) == (not near[i].any() if add == 0 else not near[:, i].any())
            if root >= 0:
                assert parts.get(i + add, i + add) == parts.get(root, root)
