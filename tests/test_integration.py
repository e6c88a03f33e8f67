"""Invariants and end-to-end checks on the test tables."""

from __future__ import annotations

import pytest

from kpiforge.operators import metrics
from kpiforge.plans import report, views
from kpiforge.plans.tables import FilterSpec, OrderTables
from kpiforge.session import scratch_path
from kpiforge.sinks.files import bundle_stamp, export_csv, read_exported_orders, write_bundle
from kpiforge.sources.jdbc import jdbc_options
from kpiforge.sources.orders import check_schema, conform_test_tables, read_orders
from tests.conftest import SF_TINY

AS_OF = "2001-06-15 00:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    return OrderTables(conform_test_tables(spark, SF_TINY), as_of=AS_OF, materialized=True)


def test_status_shares_add_up(tables):
    shares = [r["pct_share"] for r in metrics.vw_order_status(tables.clean).collect()]
    assert abs(sum(shares) - 100) <= 0.05


def test_pivot_total_equals_category_total(tables):
    piv = metrics.category_region_pivot(tables.clean)
    cols = [c for c in piv.columns if c != "category"]
    piv_total = sum(sum(r[c] for c in cols) for r in piv.collect())
    cat_total = sum(r["revenue"] for r in metrics.revenue_by_category(tables.clean).collect())
    assert piv_total == pytest.approx(cat_total, abs=0.01 * len(cols) * 10)


def test_clean_ids_unique_and_regional_orders_sum(tables):
    clean = tables.clean
    n = clean.count()
    assert clean.select("order_id").distinct().count() == n
    assert sum(r["total_orders"] for r in metrics.vw_regional_sales(clean).collect()) == n


def test_csv_roundtrip(spark, tables):
    path = export_csv(tables.clean, scratch_path(spark, "test_csv"))
    back = read_exported_orders(spark, path)
    assert back.schema == tables.clean.schema
    assert back.exceptAll(tables.clean).count() == 0
    assert tables.clean.exceptAll(back).count() == 0


def test_report_bundle_written(spark, tables):
    t = OrderTables(tables.raw, as_of=AS_OF, filters=FilterSpec(categories=["PROMO"]))
    out = scratch_path(spark, "bundle")
    paths = write_bundle(report.report_tables(t), out, bundle_stamp())
    assert set(paths) == {"kpi_cards", "category", "revenue_trend", "regional", "data_quality", "raw_data"}
    cards = spark.read.parquet(paths["kpi_cards"])
    assert cards.count() == 6
    raw_data = spark.read.parquet(paths["raw_data"])
    assert raw_data.count() == t.filtered.count()
    assert "Order Id" in raw_data.columns


def test_views_registered_for_sql(spark, tables):
    names = views.register_views(tables.raw, tables.clean, AS_OF)
    assert len(names) == 8
    assert spark.sql("SELECT count(*) AS n FROM vw_top_orders").first()["n"] == 10
    via_sql = spark.sql("SELECT * FROM vw_category_performance WHERE category = 'PROMO'").collect()
    assert len(via_sql) == 1


def test_read_orders_parquet_and_csv(spark, tables):
    path = scratch_path(spark, "orders_parquet")
    tables.raw.write.parquet(path)
    df = read_orders(spark, path)
    assert df.count() == tables.raw.count()
    bad = tables.raw.drop("status")
    with pytest.raises(ValueError):
        check_schema(bad)
    csv_path = export_csv(tables.raw, scratch_path(spark, "orders_csv"))
    assert read_orders(spark, csv_path, fmt="csv").count() == tables.raw.count()


def test_jdbc_options():
    opts = jdbc_options(
        "jdbc:postgresql://db:5432/sales", table="orders", user="u", password="p",
        partition_column="order_date", lower_bound="2023-01-01", upper_bound="2025-01-01",
        num_partitions=64,
    )
    assert opts["dbtable"] == "orders" and opts["numPartitions"] == "64"
    assert opts["partitionColumn"] == "order_date"
    view = jdbc_options("jdbc:postgresql://db/sales", query="SELECT * FROM vw_revenue_trend")
    assert view["query"].startswith("SELECT") and "dbtable" not in view
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", query="q")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", partition_column="c")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", query="q", partition_column="c", lower_bound=1, upper_bound=2, num_partitions=2)


def test_refresh_stream_equals_batch(spark, tables):
    from kpiforge.streaming.refresh import refresh_once

    streamed = refresh_once(spark, tables.raw, as_of=AS_OF)
    batch = metrics.vw_category_performance(tables.clean)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_preview_and_formatted_tables(tables):
    prev = metrics.preview_orders(tables.clean, 25).collect()
    assert len(prev) == 25
    dates = [r["order_date"] for r in prev]
    assert dates == sorted(dates)
    assert all(r["revenue_text"].startswith("₹") for r in prev if r["revenue"] is not None)
    fmt = report.category_table_formatted(tables.clean).collect()
    assert all(r["Revenue"].startswith("₹") for r in fmt)


def test_record_funnel_counts(tables):
    t = OrderTables(tables.raw, as_of=AS_OF, filters=FilterSpec(categories=["PROMO"]))
    rows = {r["stage"]: r["records"] for r in t.funnel.collect()}
    assert rows["Raw Data"] >= rows["After Dedup"] >= rows["After Null Fill"] >= rows["Final Clean"]
    assert rows["After Null Fill"] == t.clean.count()
    assert rows["Final Clean"] == t.filtered.count()


def test_etl_job_writes_every_table(spark, tables):
    from kpiforge.plans.etl import run_etl

    out = scratch_path(spark, "etl")
    paths = run_etl(tables.raw, out, as_of="2001-06-15 00:00:00", filters=FilterSpec(categories=["PROMO"]))
    assert "vw_regional_sales" in paths and "report/kpi_cards" in paths and "clean_orders" in paths
    assert spark.read.parquet(paths["clean_orders"]).count() == tables.clean.count()
    assert spark.read.parquet(paths["vw_data_quality"]).count() == 4
    assert spark.read.parquet(paths["report/raw_data"]).count() > 0


def test_cli_entry_point(spark):
    from kpiforge.__main__ import main

    out = scratch_path(spark, "cli")
    paths = main(["--star-dir", SF_TINY, "--out", out, "--as-of", "2001-06-15 00:00:00", "--partition-by-month",
                  "--category", "PROMO", "--status", "Completed"])
    assert spark.read.parquet(paths["report/category"]).count() == 1


def test_approximate_options_stay_close(tables):
    from kpiforge.operators.cleaning import category_median

    exact = {r["category"]: float(r["median_revenue"]) for r in tables.medians.collect()}
    approx = {r["category"]: float(r["median_revenue"])
              for r in category_median(tables.raw, approx_accuracy=10_000).collect()}
    assert exact.keys() == approx.keys()
    for k in exact:
        assert approx[k] == pytest.approx(exact[k], rel=0.02)
    e = metrics.vw_regional_sales(tables.clean).collect()
    a = {r["region"]: r["unique_customers"] for r in metrics.vw_regional_sales(tables.clean, 0.02).collect()}
    for r in e:
        assert abs(a[r["region"]] - r["unique_customers"]) <= 0.08 * r["unique_customers"] + 1
    k = metrics.kpi_summary(tables.clean, approx_rsd=0.02).first()
    assert k["unique_customers"] > 0


def test_fixture_expected_counts_sf001(spark):
    """The counts FIXTURES.md lists for sf0.01 (compared there row by row with DuckDB)."""
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    log = {r["issue_type"]: r["issue_count"] for r in e.queries()["issue_log"](spark, sf).collect()}
    dq = {r["issue_type"]: r["issue_count"] for r in e.queries()["vw_data_quality"](spark, sf).collect()}
    assert log == {
        "Missing Values": 937,
        "Duplicate Order IDs": 60_000 - 45_832,
        "Negative Revenue": 189,
        "Future Dates": 871,
        "Records After Cleaning": 45_643,
    }
    assert dq == {
        "Missing Revenue": 937,
        "Duplicate Order IDs": 60_000 - 45_832,
        "Future Dates": 1_141,
        "Negative Revenue": 267,
    }


def test_reload_sees_new_files(spark):
    from kpiforge.sources.orders import read_orders

    raw = conform_test_tables(spark, SF_TINY)
    path = scratch_path(spark, "reload")
    src = raw.orderBy("order_id", "order_date", "revenue")
    src.limit(3000).write.parquet(path)
    t = OrderTables(read_orders(spark, path), as_of=AS_OF, source=lambda: read_orders(spark, path))
    before = t.clean.count()
    src.subtract(src.limit(3000)).write.mode("append").parquet(path)
    t2 = t.reload()
    assert t2.raw.count() == raw.count()
    assert t2.clean.count() >= before
    q = {r["Issue Type"]: r["last_refreshed"] for r in report.report_quality(t2.issues, AS_OF).collect()}
    assert set(q.values()) == {"15 Jun 2001 00:00:00"}
