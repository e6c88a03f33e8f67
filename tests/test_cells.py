"""Filtered KPIs from cells equal those from the orders, for every kind of filter."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from kpiforge.operators import metrics
from kpiforge.plans import cells
from kpiforge.plans.tables import FilterSpec
from tests.conftest import order, orders_df


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def clean(spark):
    r = random.Random(8)
    rows = []
    for k in range(900):
        day = dt.datetime(2000, 1, 1) + dt.timedelta(days=r.randint(0, 200), hours=r.choice([0, 23]))
        rows.append(
            order(
                f"O{k}", r.choice([None, *[day.isoformat(sep=" ")] * 9]), r.choice(["A", "B", None]), r.choice(["N", "S", "E", None]), "UPI",
                r.choice(["Completed", "Completed", "Cancelled", "Pending", None]), r.choice([None, "1.00", "2.50", "99.99"]), 1,
                r.choice([None, *["hot"] * 5, *[f"C{i}" for i in range(300)]]),
            )
        )
    rows.append(order("lonely", "2001-01-05 00:00:00", "Z", "nobody", customer=None))
    return orders_df(spark, rows).repartition(4).persist()


@pytest.fixture(scope="module")
def built(clean):
    return cells.build_cells(clean)


FILTERS = [
    FilterSpec(),
    FilterSpec(date_from="2000-02-01", date_to="2000-04-30"),
    FilterSpec(date_from="2000-02-10", date_to="2000-05-03", categories=["A"]),
    FilterSpec(date_from="2000-02-10", date_to="2000-02-20", statuses=["Completed", "Pending"]),
    FilterSpec(date_from="2000-02-28", date_to="2000-03-01"),
    FilterSpec(date_to="2000-03-30", regions=["N", "S"]),
    FilterSpec(date_from="2000-05-31"),
    FilterSpec(date_from="1990-01-01", date_to="1990-12-31"),
    FilterSpec(date_from="2000-05-01", date_to="2000-04-01"),
    FilterSpec(categories=["All"], regions=["nobody"]),
    FilterSpec(categories=["no such"]),
]


@pytest.mark.parametrize("filters", FILTERS, ids=range(len(FILTERS)))
def test_every_filter(clean, built, filters):
    rows = filters.apply(clean)
    assert _rows(cells.kpi_summary_from_cells(built, filters)) == _rows(metrics.kpi_summary(rows))
    assert _rows(cells.report_regional_from_cells(built, filters)) == _rows(metrics.report_regional(rows))


def test_customers_are_numbered_densely_and_alike(clean):
    got = [sorted(_rows(cells.number_customers(clean.repartition(n), 7))) for n in (2, 5)]
    assert got[0] == got[1]
    assert sorted(n for _, n in got[0]) == list(range(1, clean.select("customer_id").dropna().distinct().count() + 1))


def test_many_customers_fill_several_bitmaps(spark):
    rows = spark.range(70_000).selectExpr(
        "concat('O', id) AS order_id", "TIMESTAMP_NTZ'2000-01-05 00:00:00' + make_dt_interval(CAST(id % 40 AS INT)) AS order_date", "'A' AS category",
        "IF(id % 2 = 0, 'N', 'S') AS region", "'UPI' AS payment_method", "'Completed' AS status", "CAST(1 AS DECIMAL(18,4)) AS revenue",
        "1 AS quantity", "concat('C', id div 2) AS customer_id",
    )
    built = cells.build_cells(rows)
    assert built.months.agg({"bucket": "max"}).first()[0] == 2
    for f in (FilterSpec(), FilterSpec(date_from="2000-01-10", date_to="2000-02-05")):
        assert _rows(cells.kpi_summary_from_cells(built, f)) == _rows(metrics.kpi_summary(f.apply(rows)))


def test_no_orders_are_read(built):
    f = FILTERS[2]
    for df in (cells.kpi_summary_from_cells(built, f), cells.report_regional_from_cells(built, f)):
        plan = df._jdf.queryExecution().toString()
        assert {p.rsplit("/", 2)[-2].rsplit("-", 1)[0] for p in df.inputFiles()} == {"cells_rollup", "cells_months", "cells_days"}
        assert "order_id" not in plan and "PushedFilters: [IsNotNull(sale_date)" in plan and "GreaterThanOrEqual(month" in plan


def test_empty_orders(clean):
    built = cells.build_cells(clean.limit(0))
    assert _rows(cells.kpi_summary_from_cells(built, FILTERS[1])) == _rows(metrics.kpi_summary(clean.limit(0)))
    assert _rows(cells.report_regional_from_cells(built, FILTERS[0])) == []
