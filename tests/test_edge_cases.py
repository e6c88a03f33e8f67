
from __future__ import annotations

from decimal import Decimal

import pytest

from kpiforge.functions.expressions import money
from kpiforge.operators import cleaning, filters, metrics
from kpiforge.plans import views
from kpiforge.plans.tables import OrderTables
from tests.conftest import order, orders_df

AS_OF = "2001-06-15 00:00:00"


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_null_keys_dropped_in_metrics_kept_in_views(spark):
    raw = orders_df(
        spark,
        [
            order("A", category=None, revenue="5.00"),
            order("B", region=None, revenue="7.00"),
            order("C", status=None, revenue="9.00"),
            order("D", revenue=None),
            order("E", revenue="20.00"),
        ],
    )
    clean = OrderTables(raw, as_of=AS_OF).clean
    # value of the null-category row is not lost in the fill
    filled = {r["order_id"]: r["revenue"] for r in clean.collect()}
    assert filled["A"] == Decimal("5.0000")
    assert filled["D"] == Decimal("9.0000")  # median of Books: 7.00, 9.00, 20.00

    cats = {r["category"] for r in metrics.revenue_by_category(clean).collect()}
    assert None not in cats
    assert None in {r["category"] for r in metrics.vw_category_performance(clean).collect()}
    assert None not in {r["region"] for r in metrics.orders_by_region(clean).collect()}
    assert None in {r["region"] for r in metrics.vw_regional_sales(clean).collect()}
    assert None not in {r["status"] for r in metrics.status_distribution(clean).collect()}
    assert None in {r["status"] for r in metrics.vw_order_status(clean).collect()}


def test_null_ids_pandas_vs_sql_duplicate_count(spark):
    raw = orders_df(
        spark,
        [
            order(None, revenue="1.00"),
            order(None, revenue="2.00"),
            order("X", revenue="3.00"),
            order("X", revenue="4.00"),
            order("Y"),
            order("Z"),
        ],
    )
    t = OrderTables(raw, as_of=AS_OF)
    log = {r["issue_type"]: r["issue_count"] for r in t.issues.collect()}
    assert log["Duplicate Order IDs"] == 2
    dq = {r["issue_type"]: r["issue_count"] for r in views.vw_data_quality(raw, AS_OF).collect()}
    assert dq["Duplicate Order IDs"] == 3
    # the earliest copy (ties broken by every column) survives
    kept = {r["order_id"]: r["revenue"] for r in t.deduped.collect()}
    assert kept["X"] == Decimal("3.0000") and kept[None] == Decimal("1.0000")


def test_all_null_group(spark):
    raw = orders_df(
        spark,
        [order("A", category="Toys", revenue=None), order("B", category="Toys", revenue=None),
         order("C", category="Books", revenue="4.00")],
    )
    t = OrderTables(raw, as_of=AS_OF)
    med = {r["category"]: r["median_revenue"] for r in t.medians.collect()}
    assert med["Toys"] is None and med["Books"] == Decimal("4.0000")
    assert t.clean.count() == 3  # rows still missing revenue are kept
    by_cat = {r["category"]: r["revenue"] for r in metrics.revenue_by_category(t.clean).collect()}
    assert by_cat["Toys"] == 0.0
    view = {r["category"]: r for r in metrics.vw_category_performance(t.clean).collect()}
    assert view["Toys"]["total_revenue"] is None and view["Toys"]["avg_order_value"] is None
    assert {r["category"]: r["avg_order_value"] for r in metrics.aov_by_category(t.clean).collect()}["Toys"] is None
    prof = {r["column_name"]: r["missing_count"] for r in cleaning.null_profile(raw).collect()}
    assert prof["revenue"] == 2 and prof["order_id"] == 0


def test_empty_frame(spark):
    raw = orders_df(spark, [])
    t = OrderTables(raw, as_of=AS_OF)
    k = metrics.kpi_summary(t.clean).first()
    assert k["total_revenue"] == 0.0 and k["total_orders"] == 0 and k["completed_orders"] == 0
    assert k["avg_order_value"] is None and k["cancellation_rate"] is None
    assert k["unique_customers"] == 0
    log = _rows(t.issues)
    assert [r["issue_type"] for r in log] == ["Records After Cleaning"]
    assert log[0]["action"] == "Started with 0"
    assert metrics.vw_top_orders(t.clean).count() == 0
    assert _rows(views.vw_data_quality(raw, AS_OF))[0]["issue_count"] == 0


def test_ties_same_result_on_repartitioned_input(spark):
    rows = [
        order("D", revenue="5.00", customer=f"CUST-{i % 3}", region=["North", "South"][i % 2])
        for i in range(12)
    ] + [order(f"U{i}", revenue="5.00") for i in range(20)]
    base = orders_df(spark, rows)
    a = sorted(map(tuple, OrderTables(base, as_of=AS_OF).clean.collect()))
    b = sorted(map(tuple, OrderTables(base.repartition(7), as_of=AS_OF).clean.collect()))
    c = sorted(map(tuple, OrderTables(base.repartition(3, "customer_id"), as_of=AS_OF).clean.collect()))
    assert a == b == c
    top_a = [r["order_id"] for r in metrics.vw_top_orders(OrderTables(base, as_of=AS_OF).clean).collect()]
    top_b = [
        r["order_id"]
        for r in metrics.vw_top_orders(OrderTables(base.repartition(5), as_of=AS_OF).clean).collect()
    ]
    assert top_a == top_b


def test_top_orders_nulls_first(spark):
    raw = orders_df(
        spark,
        [order("N", category="Ghost", revenue=None)]
        + [order(f"O{i}", revenue=f"{i}.00") for i in range(1, 15)]
        + [order("P", status="Pending", revenue="999.00")],
    )
    clean = OrderTables(raw, as_of=AS_OF).clean
    top = _rows(metrics.vw_top_orders(clean))
    assert len(top) == 10
    assert top[0]["order_id"] == "N" and top[0]["revenue"] is None
    assert [r["order_id"] for r in top[1:4]] == ["O14", "O13", "O12"]


def test_boundaries_inclusive_dates_and_future(spark):
    raw = orders_df(
        spark,
        [
            order("F", date="2001-01-01 00:00:00"),
            order("T", date="2001-01-31 23:59:59"),
            order("X", date="2001-02-01 00:00:00"),
            order("NOW", date="2001-06-15 12:00:00"),
            order("LATER", date="2001-06-15 18:00:00"),
            order("NULLDATE", date=None),
        ],
    )
    got = {r["order_id"] for r in filters.filter_orders(raw, "2001-01-01", "2001-01-31").collect()}
    assert got == {"F", "T"}
    as_of = "2001-06-15 12:00:00"
    t = OrderTables(raw, as_of=as_of)
    log = {r["issue_type"]: r["issue_count"] for r in t.issues.collect()}
    assert log["Future Dates"] == 1  # timestamp comparison: only LATER
    dq = {r["issue_type"]: r["issue_count"] for r in views.vw_data_quality(raw, as_of).collect()}
    assert dq["Future Dates"] == 2  # date comparison: NOW and LATER
    checked = {r["checked_at"] for r in views.vw_data_quality(raw, as_of).collect()}
    assert len(checked) == 1


@pytest.mark.parametrize(
    "cats,expected",
    [([], 3), (["All"], 3), (["All", "Books"], 3), (["Books"], 2), (["Nope"], 0), (None, 3)],
)
def test_filter_lists(spark, cats, expected):
    raw = orders_df(
        spark, [order("A", category="Books"), order("B", category="Books"), order("C", category="Toys")]
    )
    assert filters.filter_orders(raw, categories=cats).count() == expected


def test_half_cents_round_half_up_and_scale_kept(spark):
    df = spark.createDataFrame(
        [(Decimal("0.125"),), (Decimal("2.675"),), (Decimal("-2.675"),)], "x decimal(18,4)"
    )
    assert [r[0] for r in df.select(money("x")).collect()] == [0.13, 2.68, -2.68]
    raw = orders_df(
        spark,
        [order("A", revenue="1.00"), order("B", revenue="1.01"), order("C", revenue=None)],
    )
    t = OrderTables(raw, as_of=AS_OF)
    assert {r["order_id"]: r["revenue"] for r in t.clean.collect()}["C"] == Decimal("1.0050")


def test_no_issues_only_final_row(spark):
    raw = orders_df(spark, [order(f"O{i}", customer=f"CUST-{i}") for i in range(5)])
    log = _rows(OrderTables(raw, as_of=AS_OF).issues)
    assert log == [
        {"step": 5, "issue_type": "Records After Cleaning", "issue_count": 5, "action": "Started with 5"}
    ]
    sev = _rows(cleaning.issue_severity(OrderTables(raw, as_of=AS_OF).issues))
    assert sev[0]["severity"] == "ok"


def test_negative_revenue_dropped_after_dedup_and_counted(spark):
    raw = orders_df(
        spark,
        [
            order("A", date="2000-01-01 00:00:00", revenue="-5.00"),
            order("A", date="2000-01-02 00:00:00", revenue="-6.00"),
            order("B", revenue="-1.00"),
            order("C", revenue="3.00"),
        ],
    )
    t = OrderTables(raw, as_of=AS_OF)
    log = {r["issue_type"]: r["issue_count"] for r in t.issues.collect()}
    assert log["Negative Revenue"] == 2  # counted after dedup
    dq = {r["issue_type"]: r["issue_count"] for r in views.vw_data_quality(raw, AS_OF).collect()}
    assert dq["Negative Revenue"] == 3  # the view counts raw rows
    assert {r["order_id"] for r in t.clean.collect()} == {"C"}
    sev = {r["issue_type"]: r["severity"] for r in cleaning.issue_severity(t.issues).collect()}
    assert sev["Negative Revenue"] == "warn" and sev["Records After Cleaning"] == "ok"


def test_kpi_delta_previous_window(spark):
    from kpiforge.operators.metrics import kpi_delta, previous_window
    import datetime as dt

    assert previous_window("2000-07-01", "2000-09-30") == (dt.date(2000, 3, 31), dt.date(2000, 6, 30))
    raw = orders_df(
        spark,
        [
            order("P1", date="2000-06-30 00:00:00", revenue="100.00"),
            order("C1", date="2000-07-01 00:00:00", revenue="150.00"),
            order("C2", date="2000-09-30 10:00:00", status="Cancelled", revenue="1.00"),
            order("OUT", date="2000-10-01 00:00:00", revenue="999.00"),
        ],
    )
    rows = {r["metric"]: r for r in kpi_delta(raw, "2000-07-01", "2000-09-30").collect()}
    assert rows["Total Revenue"]["current_value"] == 150.0
    assert rows["Total Revenue"]["previous_value"] == 100.0
    assert rows["Total Revenue"]["delta_pct"] == pytest.approx(50.0)
    assert rows["Cancellation Rate"]["previous_value"] == 0.0
    assert rows["Cancellation Rate"]["delta_pct"] is None
    assert rows["Total Orders"]["current_value"] == 2.0


def test_kpi_cards_text(spark):
    from kpiforge.plans.report import kpi_cards

    raw = orders_df(
        spark,
        [order("A", revenue="1234567.50", customer="C1"), order("B", status="Cancelled", customer="C2"),
         order("C", revenue="2.50", customer="C1")],
    )
    cards = {r["label"]: r["value_text"] for r in kpi_cards(metrics.kpi_summary(raw)).collect()}
    assert cards["Total Revenue"] == "₹1,234,570"
    assert cards["Total Orders"] == "3"
    assert cards["Cancellation Rate"] == "33.33%"
    assert cards["Unique Customers"] == "2"
    assert cards["Avg Order Value"] == "₹617,285"


def test_filter_domains_all_first(spark):
    raw = orders_df(spark, [order("A", category="b"), order("B", category="a"), order("C", category=None)])
    dom = [
        (r["position"], r["value"])
        for r in filters.filter_domains(raw, ["category"]).orderBy("position").collect()
    ]
    assert dom == [(1, "All"), (2, "a"), (3, "b")]
