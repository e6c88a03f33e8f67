"""Values do not change on the way in or out; averages round once; plans stay lean."""

from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kpiforge.functions.expressions import avg_money, exact_ratio, pct
from kpiforge.operators import cleaning, metrics
from kpiforge.operators.filters import date_range
from kpiforge.plans import report, views
from kpiforge.plans.etl import run_etl
from kpiforge.plans.tables import FilterSpec, OrderTables
from kpiforge.schema import ORDERS_SCHEMA
from kpiforge.session import scratch_path, scratch_scope, materialize
from kpiforge.sinks.files import csv_name, export_csv, read_exported_orders
from kpiforge.sources.orders import conform_test_tables, read_orders
from tests.conftest import SF_TINY, order, orders_df

AS_OF = "2001-06-15 00:00:00"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


ODD = [
    ("a", dt.datetime(2000, 1, 1, 13, 5), " B ", " North ", 'say "x"', "multi\nline", Decimal("1.50"), 1, ""),
    (None, None, None, "a,b", "\\", "it's", None, None, "c"),
    ("z", dt.datetime(2000, 1, 1, 0, 0, 0, 123000), '"', '""', ",", "\t", Decimal("-1.00"), 2, "é"),
]


def test_csv_round_trip_of_odd_values(spark):
    df = spark.createDataFrame(ODD, ORDERS_SCHEMA)
    path = export_csv(df, scratch_path(spark, "odd"))
    assert _rows(read_orders(spark, path, "csv")) == _rows(df)
    assert _rows(read_exported_orders(spark, path)) == _rows(df.withColumn("revenue", F.col("revenue").cast("decimal(18,4)")))
    one = export_csv(df, scratch_path(spark, "odd"), single_file=True)
    assert _rows(read_orders(spark, one, "csv")) == _rows(df)


def test_csv_dates_alone_when_all_are_midnights(spark):
    path = export_csv(orders_df(spark, [order("A"), order("B", None)]), scratch_path(spark, "dates"))
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert ",2000-01-10 " not in text and "2000-01-10" in text
    assert csv_name(dt.datetime(2001, 2, 3)) == "filtered_orders_20010203.csv"


def test_broken_json_raises(spark):
    for line in ('{"order_id": "a", "revenue": "abc"}', "{broken"):
        path = scratch_path(spark, "json")
        spark.createDataFrame([(line,)], "value string").write.text(path)
        with pytest.raises(Exception):
            read_orders(spark, path, "json").collect()


def test_double_revenue_is_cast_in_every_reader(spark):
    df = orders_df(spark, [order("A", revenue="0.10")]).withColumn("revenue", F.col("revenue").cast("double"))
    path = scratch_path(spark, "double")
    df.write.parquet(path)
    assert read_orders(spark, path).schema["revenue"].dataType.simpleString() == "decimal(18,2)"


def test_averages_and_shares_round_once(spark):
    df = spark.range(30_000).select(F.when(F.col("id") == 0, "0.0049").otherwise("0.0050").cast("decimal(18,4)").alias("r"))
    row = df.agg(avg_money("r").alias("a"), avg_money(-F.col("r")).alias("b"), exact_ratio(F.sum("r"), F.lit(0)).alias("z")).first()
    assert (row["a"], row["b"], row["z"]) == (0.0, 0.0, None)
    half = spark.createDataFrame([("0.0050",), ("-0.0050",), (None,)], "r string").select(exact_ratio(F.col("r").cast("decimal(18,4)"), F.lit(1), 4).alias("x"))
    assert [r["x"] for r in half.collect()] == [0.01, -0.01, None]
    n = spark.range(1).select(pct(F.lit(1), F.lit(8)).alias("a"), pct(F.lit(1), F.lit(800)).alias("b"), pct(F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(n) == (12.5, 0.13, None)


def test_aov_of_many_half_cents(spark):
    raw = spark.range(30_000).select(
        F.concat(F.lit("O"), "id").alias("order_id"), F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz").alias("order_date"),
        F.lit("B").alias("category"), F.lit("N").alias("region"), F.lit("U").alias("payment_method"), F.lit("Completed").alias("status"),
        F.when(F.col("id") == 0, "0.0049").otherwise("0.0050").cast("decimal(18,4)").alias("revenue"), F.lit(1).alias("quantity"), F.lit("C").alias("customer_id"),
    )
    assert metrics.aov_by_category(raw).first()["avg_order_value"] == 0.0
    assert metrics.vw_category_performance(raw).first()["avg_order_value"] == 0.0


def test_pivot_names_and_scans(spark):
    df = orders_df(spark, [order("1", region="A B"), order("2", region="A_B", revenue="3.00"), order("3", region="category"), order("4", region="a b")])
    out = metrics.category_region_pivot(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 5
    path = scratch_path(spark, "pivot")
    out.write.parquet(path)
    assert sorted(spark.read.parquet(path).drop("category").first()) == [3.0, 10.0, 10.0, 10.0]
    assert metrics.category_region_pivot(df.limit(0)).columns == ["category"]


def test_kpi_delta_copies_no_rows(spark):
    t = OrderTables(conform_test_tables(spark, SF_TINY), as_of=AS_OF)
    assert "Expand" not in _plan(metrics.kpi_delta(t.clean, "2000-07-01", "2000-09-30"))
    empty = metrics.kpi_delta(t.clean, "2090-07-01", "2090-09-30").collect()
    assert [(r["current_value"], r["delta_pct"]) for r in empty] == [(0.0, None), (0.0, None), (None, None), (None, None), (0.0, None), (0.0, None)]


def test_clean_chain_reads_the_source_twice(spark):
    path = scratch_path(spark, "scans")
    conform_test_tables(spark, SF_TINY).write.parquet(path)
    spark.catalog.clearCache()
    raw = read_orders(spark, path)
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    clean = OrderTables(raw, as_of=AS_OF).clean  # the median histogram is the first read
    assert _plan(clean).count(path[-20:]) == 1  # the fill and dedup the second
    clean.count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached


def test_bad_date_bounds_are_refused():
    for bad in ("2000-01-01 13:00:00", "2000-01-01x"):
        with pytest.raises(ValueError):
            date_range(bad)


def test_sorted_outputs_come_sorted(spark):
    t = OrderTables(conform_test_tables(spark, SF_TINY), as_of=AS_OF)
    clean = t.clean
    cases = [
        (metrics.revenue_by_month(clean), "month", False), (metrics.vw_revenue_trend(clean), "month", False),
        (metrics.report_revenue_trend(clean), "Month", False), (metrics.vw_daily_sales_30d(clean, AS_OF), "sale_date", False),
        (metrics.revenue_by_category(clean), "revenue", True), (metrics.vw_category_performance(clean), "total_revenue", True),
        (metrics.vw_regional_sales(clean), "total_revenue", True), (metrics.vw_payment_methods(clean), "total_revenue", True),
        (metrics.status_distribution(clean), "orders", True), (metrics.revenue_by_payment(clean), "revenue", False),
        (metrics.vw_top_orders(clean), "revenue", True), (metrics.preview_orders(clean), "order_date", False),
    ]
    for df, column, falling in cases:
        got = [r[column] for r in df.collect()]
        assert got == sorted(got, reverse=falling) and len(got) > 1, column


def test_batch_job_tables_equal_their_definitions(spark):
    raw = materialize(conform_test_tables(spark, SF_TINY), "etl_raw")
    f = FilterSpec(date_from="1996-01-01", date_to="1997-06-30", categories=["PROMO", "SMALL"], statuses=["Completed", "Cancelled", "Refunded"])
    t = OrderTables(raw, as_of=AS_OF, filters=f)
    want = views.build_views(t.raw, t.clean, AS_OF) | {f"report/{k}": v for k, v in report.report_tables(t).items()}
    want |= {
        "clean_orders": t.clean, "category_median": t.medians, "issue_log": cleaning.issue_severity(t.issues),
        "null_profile": cleaning.null_profile(t.raw), "record_funnel": t.funnel,
    }
    for month in (False, True):
        paths = run_etl(raw, scratch_path(spark, "etl"), as_of=AS_OF, filters=f, partition_by_month=month)
        assert set(paths) == set(want)
        for name, path in paths.items():
            got = spark.read.parquet(path)
            assert _rows(got.select(*want[name].columns)) == _rows(want[name]), name


def test_scratch_scope_deletes_what_was_written_inside(spark):
    import os

    with scratch_scope(spark):
        path = materialize(spark.range(3), "scoped").inputFiles()[0]
    folder = os.path.dirname(path).removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(folder)
