"""Exact distributed median against a brute-force median."""

from __future__ import annotations

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiforge.operators.median import group_median


def _brute(rows):
    groups = {}
    for k, v in rows:
        groups.setdefault(k, [])
        if v is not None:
            groups[k].append(v)
    return {k: (statistics.median(vs) if vs else None) for k, vs in groups.items()}


def _spark_medians(spark, rows, **opts):
    df = spark.createDataFrame(rows, "k string, v double")
    out = group_median(df, "k", "v", **opts).collect()
    return {r["k"]: r["median"] for r in out}


@pytest.mark.parametrize("max_group_rows", [1_000_000, 40, 7])
def test_matches_brute_force_with_and_without_refinement(spark, max_group_rows):
    rnd = random.Random(7)
    rows = []
    # one hot group holding most rows, with many ties; small groups; a NULL key group
    rows += [("hot", float(rnd.randint(0, 300)) / 4) for _ in range(1501)]
    rows += [("even", float(rnd.randint(-50, 50))) for _ in range(200)]
    rows += [("one", 3.25)]
    rows += [(None, float(x)) for x in (1, 2, 3, 10)]
    rows += [("empty", None), ("empty", None)]
    rows += [("mixed", None), ("mixed", 5.0), ("mixed", 7.0)]
    got = _spark_medians(spark, rows, max_group_rows=max_group_rows, grid=10)
    want = _brute(rows)
    assert set(got) == set(want)
    for k in want:
        if want[k] is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_refinement_shrinks_window_on_distinct_values(spark):
    rnd = random.Random(11)
    rows = [("g", rnd.random() * 1000) for _ in range(4000)] + [("h", rnd.random()) for _ in range(10)]
    got = _spark_medians(spark, rows, max_group_rows=30, grid=8)
    want = _brute(rows)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_matches_spark_median_on_test_data(spark):
    from kpiforge.sources.orders import conform_test_tables

    raw = conform_test_tables(spark, "/root/testdata/sf0.001")
    mine = {
        r["category"]: r["median"]
        for r in group_median(raw, "category", "revenue", max_group_rows=100, grid=16).collect()
    }
    ref = {
        r["category"]: r["m"]
        for r in raw.groupBy("category").agg(F.median(F.col("revenue").cast("double")).alias("m")).collect()
    }
    assert mine.keys() == ref.keys()
    for k in ref:
        assert mine[k] == pytest.approx(ref[k], abs=1e-9)


_rows_strategy = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", None]),
        st.one_of(st.none(), st.integers(-50, 50).map(lambda x: x / 4)),
    ),
    min_size=1,
    max_size=120,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=_rows_strategy, bound=st.sampled_from([2, 5, 1_000_000]))
def test_property_matches_statistics_median(spark, rows, bound):
    got = _spark_medians(spark, rows, max_group_rows=bound, grid=4)
    want = _brute(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        if v is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(v, abs=1e-9)
