import random
from itertools import product

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqsieve.operators import binning, select, sweep
from seqsieve.specs import Spec, parse_specs, threshold_sets

SPECS = "[library; n; 2,5,5,9] + [library; p; 0.1-0.5/3] * [library; n; 3,4]"


def naive(rows, grid):
    """Each set by itself."""
    out = []
    for i, term in enumerate(grid.terms):
        used = grid.used(i)
        for values in product(*(term[n] for n in used)):
            low = {a for a, t, n, s in rows if any(s[k] is not None and s[k] < v for k, v in zip(used, values, strict=True))}
            target, bad = {a for a, t, n, s in rows if t}, {a for a, t, n, s in rows if n and not t}
            out.append((low, (low | bad) - target, target, bad))
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_sweep_equals_each_set_by_itself(spark, seed):
    rnd, grid = random.Random(seed), parse_specs(SPECS)
    rows = [(i, rnd.random() < 0.2, rnd.random() < 0.2, {"library_n": rnd.choice([None, 1.0, 2.0, 4.0, 5.0, 10.0]), "library_p": rnd.choice([None, 0.05, 0.1, 0.3, 0.9])}) for i in range(60)]
    df = spark.createDataFrame([(a, t, n, s["library_n"], s["library_p"]) for a, t, n, s in rows], "asv_id long, is_target boolean, is_nontarget boolean, library_n double, library_p double")
    got = sweep.sweep(df, grid).orderBy("resultindex").collect()
    want = naive(rows, grid)
    assert len(got) == len(want) == len(grid)
    for r, (low, out, target, bad) in zip(got, want, strict=True):
        assert r.asvsprelim_rejected_n == len(low) and r.asvsactual_rejected_n == len(out)
        assert r.verifiedauthentic_retained_n == len(target - low) and r.verifiednonauthentic_retained_n == len(bad - low)
        tp, tn = len(target - low), len(bad & low)
        assert r.accuracy_score == ((tp + tn) / (len(target) + len(bad)) if target or bad else 0)
    classes = {}
    for r, (_, out, _, _) in zip(got, want, strict=True):
        assert classes.setdefault(r.rejects_hash, out) == out
    assert len(classes) == len({frozenset(o) for _, o, _, _ in want})
    sets = sweep.rejects(df, threshold_sets(spark, grid), grid.names()).collect()
    by = {}
    for r in sets:
        by.setdefault(r.resultindex, set()).add(r.asv_id)
    assert all(by.get(i, set()) == out for i, (_, out, _, _) in enumerate(want))


def counts(spark, rows):
    return spark.createDataFrame(rows, "library string, asv_id string, n long")


def test_bins_are_kept_apart_and_edges(spark):
    c = counts(spark, [("T1", "a", 3), ("T11", "a", 5), ("T1", "b", 1), ("T11", "b", 0)])
    groups = {"clade": spark.createDataFrame([("11", "a"), ("1", "a"), ("1", "b")], "group_id string, asv_id string")}
    rows = {(r.library, r.clade, r.asv_id): r.value for r in binning.bin_values(c, groups, Spec("library", ("clade",), "p")).collect()}
    assert rows == {("T1", "11", "a"): 1.0, ("T1", "1", "a"): 0.75, ("T1", "1", "b"): 0.25, ("T11", "11", "a"): 1.0, ("T11", "1", "a"): 1.0}
    assert {r.asv_id: r.score for r in binning.scores(c, {}, Spec("library", (), "n"), True).collect()} == {"a": 3.0, "b": 1.0}
    assert binning.bin_values(c.filter("false"), {}, Spec("total", (), "p")).count() == 0
    one = binning.bin_values(c, {}, Spec("library", ("taxon",), "n"))
    assert {r.taxon for r in one.collect()} == {"x"}


def test_value_at_the_threshold_stays(spark):
    df = spark.createDataFrame([(1, False, False, 5.0), (2, False, True, None)], "asv_id long, is_target boolean, is_nontarget boolean, library_n double")
    r = sweep.sweep(df, parse_specs("[library; n; 5,6]")).orderBy("resultindex").collect()
    assert [x.asvsprelim_rejected_n for x in r] == [0, 1] and r[0].authentic_total_estimate is None and r[0].recall_score == 0


def test_store_round_trip(spark):
    numbers = [*range(10), 32767, 32768, 100_000]
    asvs = spark.createDataFrame([(i, f"s{i}") for i in numbers], "asv_ord long, asv_id string")
    out = {0: numbers[:3], 1: numbers[:7] + [32768], 2: numbers, 5: [100_000, 9]}
    rejected = spark.createDataFrame([(k, i) for k, v in out.items() for i in v] * 2, "resultindex long, asv_ord long")
    store = select.encode_store(rejected, asvs)
    sizes = {(r.resultindex, r.action): r.n for r in store.groupBy("resultindex", "action").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    assert sizes == {(0, "reject"): 3, (1, "retain"): 5, (2, "retain"): 0, (5, "reject"): 2}
    assert store.agg(F.max(F.length("bits"))).first()[0] == 4096
    kept = {(r.resultindex, r.asv_id) for r in select.retained_from_store(asvs, store).collect()}
    want = {(k, f"s{i}") for k, v in out.items() for i in numbers if i not in v}
    assert kept == want
    lines = spark.createDataFrame([(7, "reject", ["s3", "s32768"]), (8, "retain", ["s0"]), (9, "retain", [])], "resultindex long, action string, asv_ids array<string>")
    kept = {(r.resultindex, r.asv_id) for r in select.retained_from_store(asvs, select.store_of_ids(lines, asvs)).collect()}
    assert kept == {(7, f"s{i}") for i in numbers if i not in (3, 32768)} | {(8, "s0")}
    hashes = spark.createDataFrame([(0, 11), (1, 12), (3, 11), (4, 99), (5, 11)], "resultindex long, rejects_hash long")
    wanted = spark.createDataFrame([(3,), (4,), (5,), (2,)], "resultindex long")
    assert set(map(tuple, select.stored_twins(wanted, hashes, store).collect())) == {(3, 0), (5, 5), (2, 2)}


def test_top_proportion(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(8)], "resultindex long, accuracy_score double")
    assert {r.resultindex for r in select.top_proportion(df, "accuracy_score", 0.5).collect()} == {2, 3, 6, 7}
    assert {r.resultindex for r in select.top_proportion(df, "accuracy_score", 0.01).collect()} == {3, 7}
