"""Windows from prefix sums and pages from the order-statistic index."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from kpiforge.operators import metrics
from kpiforge.plans import cells, pages, prefix
from kpiforge.plans.rollup import order_rollup
from kpiforge.session import materialize
from tests.conftest import order, orders_df


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def clean(spark):
    r = random.Random(4)
    rows = []
    for k in range(600):
        day = dt.datetime(2000, 1, 10) + dt.timedelta(days=r.choice([0, 3, 50, 51, 52, r.randint(0, 90)]), hours=r.choice([0, 23]))
        rows.append(
            order(
                f"O{k}", r.choice([None, *[day.isoformat(sep=" ")] * 9]), r.choice(["A", "B", None]), r.choice(["N", None]), "UPI",
                r.choice(["Completed", "Completed", "Cancelled", None]), r.choice([None, "1.00", "2.50"]), 1, r.choice([None, "C1", "C2", f"C{k}"]),
            )
        )
    return materialize(orders_df(spark, rows + [order(None, "2000-02-01 00:00:00")]), "windows_clean")


@pytest.mark.parametrize(
    "window",
    [("2000-02-01", "2000-02-29"), ("2000-03-01", "2000-03-01"), ("2000-01-10", "2000-01-20"), ("1999-01-01", "1999-12-31"), ("2000-04-01", "2001-01-01"), ("1999-06-01", "2001-06-01")],
    ids=range(6),
)
def test_kpi_delta_of_any_window(clean, window):
    built = cells.build_cells(clean)
    sums = prefix.build_prefix(built.rollup)
    assert _rows(prefix.kpi_delta_from_prefix(sums, built, *window)) == _rows(metrics.kpi_delta(clean, *window))


def test_window_sums_read_two_days(clean):
    sums = prefix.build_prefix(order_rollup(clean))
    df = prefix.window_sums(sums, "2000-02-01", "2000-02-29", "region")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(sale_date, [2000-01-31,2000-02-29])]" in plan
    inside = clean.where("order_date >= '2000-02-01' AND order_date < '2000-03-01'")
    want = {r["region"]: r["n"] for r in inside.groupBy("region").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert {r["region"]: r["rows"] for r in df.collect()} == want
    assert prefix.window_sums(sums, "2000-02-29", "2000-02-01", "region").collect() == []


@pytest.mark.parametrize("as_of", ["2000-02-20 10:00:00", "2000-01-15 00:00:00", "2005-01-01 00:00:00", "2000-04-30 00:00:00"])
def test_daily_sales(clean, as_of):
    assert _rows(prefix.daily_sales_from_prefix(prefix.build_prefix(order_rollup(clean)), as_of)) == _rows(metrics.vw_daily_sales_30d(clean, as_of))


def test_prefix_of_no_orders(clean):
    none = clean.limit(0)
    built = cells.build_cells(none)
    sums = prefix.build_prefix(built.rollup)
    assert _rows(prefix.kpi_delta_from_prefix(sums, built, "2000-01-01", "2000-01-31")) == _rows(metrics.kpi_delta(none, "2000-01-01", "2000-01-31"))
    assert _rows(prefix.daily_sales_from_prefix(sums, "2000-01-01")) == []


def test_all_pages_make_up_the_ordered_table(spark, clean):
    stored = pages.write_pages(clean, parts=5)
    whole = _rows(clean.orderBy(*pages.preview_order()))
    assert stored.total() == len(whole) == 601
    for size in (7, 100, 601, 1000):
        got = []
        for n in range(-(-601 // size)):
            rows = stored.page(n, size).collect()
            assert [r["position"] for r in rows] == list(range(n * size + 1, min(601, (n + 1) * size) + 1))
            got += [tuple(r)[:-1] for r in rows]
            if size == 7 and n == 9:
                break
        assert got == whole[: len(got)]
    assert stored.page(2, 601).collect() == []
    again = pages.open_pages(spark, stored.path)
    assert _rows(again.page(3, 50)) == _rows(stored.page(3, 50))


def test_a_page_reads_the_partitions_it_lies_in(clean):
    stored = pages.write_pages(clean, parts=6)
    index = sorted((r["before"], r["rows"]) for r in stored.index.collect())
    assert len(index) >= 4 and max(n for _, n in index) < 400
    page = stored.page(3, 50)
    plan = page._jdf.queryExecution().toString()
    lies_in = [b for b, n in index if b < 200 and b + n > 150]
    assert 1 <= len(lies_in) <= 2 and "PartitionFilters: [isnotnull(page_part" in plan or "page_part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pages_of_no_orders_and_odd_numbers(clean):
    stored = pages.write_pages(clean.limit(0))
    assert stored.page(0).collect() == [] and stored.total() == 0
    with pytest.raises(ValueError):
        stored.page(-1)
