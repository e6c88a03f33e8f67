"""Storage layouts: bucketed by id, split by equal depth, answered from footers."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from kpiforge.operators import cleaning, filters
from kpiforge.session import materialize, scratch_path
from kpiforge.sources import bucketed, footers, splits
from kpiforge.sources.orders import conform_test_tables
from tests.conftest import SF_TINY, order, orders_df


@pytest.fixture(scope="module")
def raw(spark):
    return materialize(conform_test_tables(spark, SF_TINY), "layout_raw")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- bucketed by id ---------------------------------------------------------------


def test_dedup_of_a_bucketed_table_needs_no_exchange(spark, raw):
    medians = cleaning.category_median(raw)
    stored = bucketed.scratch_table(raw, "by_id", 8)
    kept = cleaning.dedup_orders(cleaning.fill_missing_median(stored, medians))
    plan = _final_plan(kept)
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    assert _rows(kept) == _rows(cleaning.dedup_orders(cleaning.fill_missing_median(raw, medians)))


def test_new_ids_meet_bucket_by_bucket(spark, raw):
    known, more = bucketed.scratch_table(raw, "known", 8), bucketed.scratch_table(raw.unionByName(orders_df(spark, [order("new"), order("new"), order(None)])), "more", 8)
    found = bucketed.new_ids(more, known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    assert [r["order_id"] for r in found.collect()].count("new") == 2 and found.count() == 3
    assert bucketed.new_ids(more, more).count() == 0


def test_bucketed_edge_rows(spark):
    rows = [order(None), order(None, "1999-01-01 00:00:00"), order("A"), order("A"), order("", revenue=None)]
    stored = bucketed.scratch_table(orders_df(spark, rows), "edge", 4)
    assert _rows(cleaning.dedup_orders(stored)) == _rows(cleaning.dedup_orders(orders_df(spark, rows)))
    assert bucketed.scratch_table(orders_df(spark, []), "none", 4).count() == 0


# --- split bounds ----------------------------------------------------------------------


def _skewed(spark):
    r = random.Random(2)
    days = [dt.datetime(2000, 6, 1) + dt.timedelta(days=r.randint(0, 30), hours=r.randint(0, 23)) for _ in range(900)]
    days += [dt.datetime(1990, 1, 1) + dt.timedelta(days=r.randint(0, 3000)) for _ in range(100)] + [dt.datetime(2000, 6, 5, 23, 59, 59)] * 500
    return orders_df(spark, [order(f"O{k}", d.isoformat(sep=" ")) for k, d in enumerate(days)] + [order("none", None)] * 40)


def test_every_row_satisfies_exactly_one_predicate(spark):
    df = _skewed(spark)
    parts = splits.equal_depth_parts(df, 10)
    predicates = splits.split_predicates(parts)
    got = {r["predicate"]: r["rows"] for r in splits.rows_by_predicate(df, predicates).collect()}
    assert sum(got.values()) == df.count() == sum(df.where(p).count() for p in predicates)
    assert got["order_date IS NULL"] == 40
    # a part holds its share, and at most one day more
    share, busiest = 1500 / 10, df.groupBy(df.order_date.cast("date")).count().agg({"count": "max"}).first()[0]
    assert all(r["rows"] <= share + busiest for r in parts.collect() if r["part"] >= 0)
    others = [r["rows"] for r in parts.collect() if r["part"] >= 0 and not r["first_day"] <= dt.date(2000, 6, 5) <= r["last_day"]]
    assert max(others) <= 2 * share and len(others) >= 5


def test_predicates_stay_open_at_both_ends(spark):
    predicates = splits.split_predicates(splits.equal_depth_parts(_skewed(spark), 4))
    late = orders_df(spark, [order("old", "1900-01-01 00:00:00"), order("new", "2100-01-01 00:00:00"), order("none", None)])
    assert [sum(late.where(p).where(f"order_id = '{i}'").count() for p in predicates) for i in ("old", "new", "none")] == [1, 1, 1]


def test_tables_without_dates(spark):
    for rows in ([], [order("A", None)]):
        df = orders_df(spark, rows)
        assert splits.split_predicates(splits.equal_depth_parts(df, 3)) == ["order_date IS NULL", "order_date IS NOT NULL"]
    one = orders_df(spark, [order("A")])
    assert splits.split_predicates(splits.equal_depth_parts(one, 3)) == ["order_date IS NULL", "order_date IS NOT NULL"]
    with pytest.raises(ValueError):
        splits.equal_depth_parts(one, 0)


# --- footers ---------------------------------------------------------------------------


def test_bounds_and_counts_come_from_footers(spark, raw):
    path = scratch_path(spark, "footer")
    footers.write_with_day(raw, path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    out = footers.table_bounds(spark, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(order_day), MAX(order_day)]" in plan and "PushedAggregation: [COUNT(*)]" in plan
    want = filters.date_bounds(raw).first()
    assert tuple(out.first()) == (want["min_date"], want["max_date"], raw.count())
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    nulls = footers.null_counts(spark, path, ["revenue", "order_id"])
    assert "PushedAggregation: [COUNT(*), COUNT(revenue), COUNT(order_id)]" in nulls._jdf.queryExecution().executedPlan().toString()
    assert tuple(nulls.first()) == (raw.count(), raw.where("revenue IS NULL").count(), 0)


def test_footers_of_odd_tables(spark):
    for rows in ([], [order("A", None)], [order("A", None), order("B", "2000-01-01 23:59:59", revenue=None)]):
        path = scratch_path(spark, "odd_footer")
        footers.write_with_day(orders_df(spark, rows), path)
        day = dt.date(2000, 1, 1) if len(rows) == 2 else None
        assert tuple(footers.table_bounds(spark, path).first()) == (day, day, len(rows))
