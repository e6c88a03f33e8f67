"""Plan-shape tests: the physical plans we rely on for scale."""

from __future__ import annotations

import re

from kpiforge.operators import cleaning, filters, metrics
from kpiforge.plans import views
from kpiforge.plans.tables import OrderTables
from kpiforge.session import materialize
from kpiforge.sources.orders import conform_test_tables
from tests.conftest import SF_TINY


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_top_orders_is_take_ordered(spark):
    raw = conform_test_tables(spark, SF_TINY)
    plan = _formatted(metrics.vw_top_orders(raw))
    assert "TakeOrderedAndProject" in plan


def test_dedup_has_partial_window_group_limit(spark):
    raw = conform_test_tables(spark, SF_TINY)
    plan = _formatted(cleaning.dedup_orders(raw))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_data_quality_reads_fact_once(spark):
    raw = materialize(conform_test_tables(spark, SF_TINY), "plan_raw")
    plan = _formatted(views.vw_data_quality(raw, "2001-06-15 00:00:00"))
    scans = [line for line in plan.splitlines() if re.match(r"^\(\d+\) Scan parquet", line)]
    assert len(scans) == 1


def test_fact_table_is_never_broadcast(spark):
    plan = _formatted(conform_test_tables(spark, SF_TINY))
    # every broadcast side is a dimension; lineitem stays the streamed side
    for block in plan.split("BroadcastExchange")[1:]:
        head = block.split("\n\n")[0]
        assert "lineitem" not in head
    assert "BuildLeft" not in plan


def test_filters_push_into_materialized_scan(spark):
    t = OrderTables(conform_test_tables(spark, SF_TINY), as_of="2001-06-15 00:00:00", materialized=True)
    df = filters.filter_orders(t.clean, "1996-01-01", "1996-12-31", categories=["PROMO"])
    plan = _formatted(df)
    assert "PushedFilters" in plan
    scan = plan[plan.index("Scan parquet"):]
    pushed = scan[scan.index("PushedFilters"):].split("\n")[0]
    assert "order_date" in pushed and "category" in pushed


def test_column_pruning_reaches_scan(spark):
    t = OrderTables(conform_test_tables(spark, SF_TINY), as_of="2001-06-15 00:00:00", materialized=True)
    plan = _formatted(metrics.revenue_by_payment(t.clean))
    schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")][0]
    assert "customer_id" not in schema and "quantity" not in schema


def test_distinct_count_is_two_level(spark):
    raw = conform_test_tables(spark, SF_TINY)
    plan = _formatted(metrics.vw_regional_sales(raw))
    # partial aggregation keyed by (region, customer_id) before the final count
    assert plan.count("HashAggregate") >= 4


def test_month_partitioned_layout_prunes_and_matches(spark):
    from kpiforge.plans.tables import FilterSpec

    raw = materialize(conform_test_tables(spark, SF_TINY), "month_raw")
    spec = FilterSpec(date_from="1996-02-10", date_to="1996-05-20", categories=["PROMO", "SMALL"])
    plain = OrderTables(raw, as_of="2001-06-15 00:00:00", filters=spec, materialized=True)
    parted = OrderTables(
        raw, as_of="2001-06-15 00:00:00", filters=spec, materialized=True, partition_by_month=True
    )
    assert parted.clean.columns == plain.clean.columns
    assert sorted(map(tuple, parted.filtered.collect())) == sorted(map(tuple, plain.filtered.collect()))
    assert parted.clean.count() == plain.clean.count()
    plan = _formatted(parted.filtered)
    part_filters = [line for line in plan.splitlines() if line.startswith("PartitionFilters")]
    assert part_filters and "order_month" in part_filters[0]
    assert dict(parted.stored.dtypes)["order_month"] == "string"
