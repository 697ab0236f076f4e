import pytest
from hypothesis import given
from hypothesis import strategies as st

from seqsieve.specs import SpecError, parse_specs, parse_thresholds, single_set, spaced, threshold_sets


def test_thresholds():
    assert parse_thresholds("1-2/5") == [1, 1.25, 1.5, 1.75, 2]
    assert parse_thresholds("1,2,3,4-10/4") == [1, 2, 3, 4, 6, 8, 10]
    assert parse_thresholds("1/2/3") == [1, 1.5, 2]
    assert parse_thresholds("1e-5") == [1e-5]
    assert parse_thresholds("1e-5-1e-4/2") == [1e-5, 1e-4]
    assert parse_thresholds("5-9/1") == [5]


@pytest.mark.parametrize("text", ["1-2", "a", "1-2/0", "1-2/x", ""])
def test_bad_thresholds(text):
    with pytest.raises(SpecError):
        parse_thresholds(text)


@given(st.floats(0, 1), st.floats(1, 2), st.integers(2, 50))
def test_spaced(a, b, n):
    x = spaced(a, b, n)
    assert len(x) == n and x[0] == a and x[-1] == b and x == sorted(x)


def test_grammar():
    text = "# a comment\n[total; n; 2-10/5] + [library|clade; p; 0.15,0.3]\n\n+ [library; p; 0.1] * [total|taxon; n; 3,5]\n * [library|clade+taxon; p; 0.03-0.07/3]"
    grid = parse_specs(text)
    assert grid.sizes() == [5, 2, 6] and len(grid) == 13
    assert grid.names() == ["total_n", "library|clade_p", "library_p", "total|taxon_n", "library|clade|taxon_p"]


@pytest.mark.parametrize("text", ["[clade; n; 1]", "[library; q; 1]", "[library; n]", "library; n; 1", "[library|genus; n; 1]", "[library; n; 1", ""])
def test_bad_specs(text):
    with pytest.raises(SpecError):
        parse_specs(text)


def test_repeated_spec_warns():
    with pytest.warns(UserWarning):
        assert parse_specs("[library;n;1]*[library;n;2,3]").terms == [{"library_n": [2.0, 3.0]}]


def test_single_set():
    assert single_set(["'[library; n; 3]'", "[total; p; 0.1]"]).sizes() == [1]
    with pytest.raises(SpecError):
        single_set(["[library; n; 3,4]"])


def test_sets_follow_the_product_order(spark):
    grid = parse_specs("[library; n; 1,2] * [library; p; 0.1,0.2,0.3] + [total; n; 9]")
    rows = threshold_sets(spark, grid).orderBy("resultindex").collect()
    assert [tuple(r)[2:] for r in rows] == [(a, b, 0.0) for a in (1.0, 2.0) for b in (0.1, 0.2, 0.3)] + [(0.0, 0.0, 9.0)]
    assert [r.resultindex for r in rows] == list(range(7)) and rows[6].term == "total_n"
