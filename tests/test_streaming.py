"""Refresh streams: nothing is lost, tables appear after every batch, scratch stays bounded."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys
import time

import pytest

from kpiforge.operators import metrics
from kpiforge.plans import views
from kpiforge.plans.tables import OrderTables
from kpiforge.session import materialize, scratch_path
from kpiforge.sinks.versions import published, read_pointer, replace_pointer
from kpiforge.sources.orders import conform_test_tables
from kpiforge.streaming import incremental
from kpiforge.streaming.incremental import (
    apply_batch,
    incremental_tables,
    keep_first_arrivals,
    refresh_incremental_once,
    start_incremental_refresh,
)
from kpiforge.streaming.refresh import start_refresh
from tests.conftest import SF_TINY, order, orders_df

AS_OF = "2001-06-15 00:00:00"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _medians(spark, base):
    spark.createDataFrame([("Books", 5)], "category string, m int").selectExpr(
        "category", "CAST(m AS DECIMAL(18,4)) AS median_revenue"
    ).write.parquet(f"{base}/medians")
    return f"{base}/medians"


def _drain(spark, base, medians, **kw):
    q = start_incremental_refresh(spark, f"{base}/inbox", f"{base}/out", f"{base}/ckpt", medians, as_of=AS_OF, available_now=True, **kw)
    q.awaitTermination()
    assert q.exception() is None
    return incremental_tables(spark, f"{base}/out")


def test_incremental_equals_batch_on_all_rows(spark):
    raw = materialize(conform_test_tables(spark, SF_TINY), "stream_raw")
    t = OrderTables(raw, as_of=AS_OF)
    got = refresh_incremental_once(spark, keep_first_arrivals(raw, t.medians), t.medians, as_of=AS_OF)
    for name, df in views.build_views(t.raw, t.clean, AS_OF).items():
        assert _rows(got[name]) == _rows(df), name
    assert _rows(got["issue_log"]) == _rows(t.issues)
    refused = got["refused_orders"].collect()
    assert sum(r["raw_rows"] for r in refused) == raw.count()
    assert sum(r["refused_rows"] for r in refused) == raw.count() - t.deduped.count()


def test_old_and_future_orders_are_kept_at_the_default_settings(spark):
    """Files 30 days apart arrive newest first, and one order is dated 2099."""
    base = scratch_path(spark, "late")
    medians = _medians(spark, base)
    for k in range(4):
        day = dt.datetime(2000, 6, 1) - dt.timedelta(days=30 * k)
        rows = [order(f"ORD-{k}-{i}", day.isoformat(sep=" ")) for i in range(100)]
        if k == 0:
            rows.append(order("ORD-future", "2099-01-01 00:00:00"))
        orders_df(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/inbox")
        time.sleep(0.05)
    t = _drain(spark, base, medians, max_files_per_trigger=1)
    assert t["vw_order_status"].collect()[0]["order_count"] == 401
    assert {r["issue_type"]: r["issue_count"] for r in t["issue_log"].collect()} == {"Future Dates": 1, "Records After Cleaning": 401}
    assert [r["refused_rows"] for r in t["refused_orders"].collect()] == [0, 0, 0, 0]


def test_null_ids_repeats_and_missing_revenue(spark):
    base = scratch_path(spark, "ids")
    medians = _medians(spark, base)
    first = [order(None), order("None"), order("A"), order("A"), order("B", revenue=None), order("C", revenue="-1.00")]
    second = [order(None), order("A", "2001-01-01 00:00:00"), order("D"), order("None")]
    for rows in (first, second):
        apply_batch(orders_df(spark, rows), 0 if rows is first else 1, f"{base}/out", medians, AS_OF)
    t = incremental_tables(spark, f"{base}/out")
    assert [tuple(r) for r in t["refused_orders"].collect()] == [(0, 6, 1), (1, 4, 3)]
    # accepted: null, None, A, B (median 5), C (negative, dropped), D
    row = t["vw_category_performance"].collect()[0]
    assert (row["total_orders"], row["total_revenue"]) == (4, 45.0)
    assert {r["issue_type"]: r["issue_count"] for r in t["vw_data_quality"].collect()} == {
        "Missing Revenue": 1, "Duplicate Order IDs": 10 - 5, "Future Dates": 0, "Negative Revenue": 1,
    }
    # a replay of a committed batch changes nothing
    before = read_pointer(spark, f"{base}/out/current.json")
    apply_batch(orders_df(spark, second), 1, f"{base}/out", medians, AS_OF)
    assert read_pointer(spark, f"{base}/out/current.json") == before


def test_running_stream_publishes_after_every_batch(spark):
    base = scratch_path(spark, "live")
    medians = _medians(spark, base)
    orders_df(spark, [order("A")]).write.parquet(f"{base}/inbox")
    q = start_incremental_refresh(spark, f"{base}/inbox", f"{base}/out", f"{base}/ckpt", medians, as_of=AS_OF, processing_time="1 second")
    try:
        for n in (1, 2):
            deadline, seen = time.time() + 120, None
            while time.time() < deadline and seen != n:
                time.sleep(0.5)
                assert q.exception() is None
                if read_pointer(spark, f"{base}/out/current.json"):
                    seen = incremental_tables(spark, f"{base}/out")["vw_order_status"].agg({"order_count": "sum"}).first()[0]
            assert seen == n and q.isActive
            orders_df(spark, [order("B")]).write.mode("append").parquet(f"{base}/inbox")
    finally:
        q.stop()


def test_state_stays_bounded_and_merges_are_neutral(spark, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_RUNS", 3)
    base = scratch_path(spark, "bounded")
    medians = _medians(spark, base)
    for k in range(10):
        apply_batch(orders_df(spark, [order(f"O{k}", customer=f"C{k % 4}"), order("same", customer="S")]), k, f"{base}/out", medians, AS_OF)
    now = read_pointer(spark, f"{base}/out/current.json")
    assert len(now["ids"]) <= 6 and len(now["customers"]) <= 6
    local = base.removeprefix("file:")
    assert len(os.listdir(f"{local}/out/state")) <= 2 * (1 + 12)
    t = incremental_tables(spark, f"{base}/out")
    row = t["vw_regional_sales"].collect()[0]
    assert (row["total_orders"], row["unique_customers"]) == (11, 5)
    assert sum(r["refused_rows"] for r in t["refused_orders"].collect()) == 9


def test_approximate_customers_option(spark):
    base = scratch_path(spark, "sketch")
    medians = _medians(spark, base)
    for k in range(2):
        apply_batch(orders_df(spark, [order(f"O{k}-{i}", customer=f"C{i}") for i in range(50)]), k, f"{base}/out", medians, AS_OF, approx_customers=True)
    n = incremental_tables(spark, f"{base}/out")["vw_regional_sales"].collect()[0]["unique_customers"]
    assert abs(n - 50) <= 3


def test_a_failed_batch_leaves_the_tables_as_they_were(spark, monkeypatch):
    base = scratch_path(spark, "failed")
    medians = _medians(spark, base)
    apply_batch(orders_df(spark, [order("A")]), 0, f"{base}/out", medians, AS_OF)
    before = published(spark, f"{base}/out")

    def broken(*a, **k):
        raise RuntimeError("stop")

    with monkeypatch.context() as m:
        m.setattr(incremental, "rollup_views", broken)
        with pytest.raises(RuntimeError):
            apply_batch(orders_df(spark, [order("B")]), 1, f"{base}/out", medians, AS_OF)
    assert published(spark, f"{base}/out") == before
    apply_batch(orders_df(spark, [order("B")]), 1, f"{base}/out", medians, AS_OF)
    assert incremental_tables(spark, f"{base}/out")["vw_order_status"].collect()[0]["order_count"] == 2


def test_pointer_is_replaced(spark):
    path = scratch_path(spark, "pointer") + "/current.json"
    assert read_pointer(spark, path) is None
    for n in (1, 2):
        replace_pointer(spark, path, {"n": n, "text": "é"})
        assert read_pointer(spark, path) == {"n": n, "text": "é"}


def test_exact_refresh_resumes_and_clears_its_scratch(spark):
    raw = materialize(conform_test_tables(spark, SF_TINY), "resume_raw")  # stable split
    first, second = raw.randomSplit([0.6, 0.4], seed=5)
    base = scratch_path(spark, "resume")
    scratch = os.path.dirname(base).removeprefix("file:")
    paths = [f"{base}/inbox", f"{base}/store", f"{base}/out", f"{base}/ckpt"]
    first.repartition(3).write.parquet(f"{base}/inbox")

    def copies():
        return sorted(x for x in os.listdir(scratch) if x.startswith(("deduped_orders", "median_", "category_median")))

    def drain():
        q = start_refresh(spark, *paths, as_of=AS_OF, available_now=True, max_files_per_trigger=1)
        q.awaitTermination()
        assert q.exception() is None

    before = copies()
    drain()
    # new files arrive; a restarted job with the same checkpoint takes only those
    second.repartition(1).write.mode("append").parquet(f"{base}/inbox")
    drain()
    assert copies() == before  # no batch left a scratch copy
    assert len([x for x in os.listdir(f"{base}/out".removeprefix("file:")) if x.startswith("v-")]) == 2
    assert spark.read.parquet(f"{base}/store").count() == raw.count()  # nothing appended twice
    t = OrderTables(raw, as_of=AS_OF)
    got = published(spark, f"{base}/out")
    for name, df in views.build_views(t.raw, t.clean, AS_OF).items():
        assert _rows(spark.read.parquet(got[name])) == _rows(df), name


def test_streams_run_outside_the_repo_folder(tmp_path):
    """Nothing that runs in tasks needs the package on the workers' path."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {repo!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]')"
        ".config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['incremental_regional_sales'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 5" in out.stdout, out.stderr[-2000:]


def test_refresh_cli_both_modes(spark):
    from kpiforge.streaming.__main__ import main

    raw = materialize(conform_test_tables(spark, SF_TINY), "cli_raw")
    base = scratch_path(spark, "refresh_cli")
    t = OrderTables(raw, as_of=AS_OF)
    keep_first_arrivals(raw, t.medians)[0].repartition(1).write.parquet(f"{base}/inbox")
    t.medians.write.parquet(f"{base}/medians")
    exact = main(["--inbox", f"{base}/inbox", "--out", f"{base}/exact", "--as-of", AS_OF, "--available-now"])
    assert spark.read.parquet(published(spark, exact)["vw_category_performance"]).count() == 6
    inc = main(["--inbox", f"{base}/inbox", "--out", f"{base}/inc", "--mode", "incremental",
                "--medians", f"{base}/medians", "--as-of", AS_OF, "--available-now"])
    assert _rows(spark.read.parquet(published(spark, inc)["vw_category_performance"])) == _rows(metrics.vw_category_performance(t.clean))
