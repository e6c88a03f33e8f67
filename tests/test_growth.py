"""What one task gets, and how often the joins run, must not grow with the input."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from kpiforge.operators import partitioning
from kpiforge.plans import pages
from kpiforge.session import CLEANUP_CONF, ensure_checkpoint_dir, materialize, scratch_path, shuffles_dropped
from kpiforge.sources.orders import conform_test_tables
from kpiforge.streaming import incremental, refresh
from tests.conftest import order, orders_df

AS_OF = "2001-06-15 00:00:00"


def _stored(spark, n=400):
    days = [f"2000-{1 + i % 12:02d}-{1 + i % 28:02d} 00:00:00" for i in range(n)]
    rows = [order(f"O{i % (n - 7)}", days[i], category=f"C{i % 3}", revenue=f"{i % 90}.10", customer=f"CUST-{i % 50}") for i in range(n)]
    return materialize(orders_df(spark, rows).repartition(2), "growth")


def _seen(monkeypatch, module):
    """Parts and files a trigger that the refresh asked for, while source files count as many."""
    asked = []
    monkeypatch.setattr(partitioning.parts_by_size, "__defaults__", (2000,))
    name = "start_refresh" if module is refresh else "start_incremental_refresh"
    start = getattr(module, name)

    def spy(spark, inbox, *args, **named):
        asked.append((len(spark.read.parquet(inbox).inputFiles()), named["max_files_per_trigger"]))
        return start(spark, inbox, *args, **named)

    monkeypatch.setattr(module, name, spy)
    return asked


def test_parts_follow_the_size_of_the_source(spark):
    stored = _stored(spark)
    few, many = partitioning.parts_by_size(stored, 3), partitioning.parts_by_size(stored, 3, 500)
    assert few == 3 and many > 6 and many % 3 == 0
    assert partitioning.parts_by_size(spark.range(10), 4, 1) == 4  # no files
    path = scratch_path(spark, "a b%20c")
    stored.write.parquet(path)
    assert partitioning.parts_by_size(spark.read.parquet(path), 1, 500) > 2


def test_arrivals_of_the_incremental_refresh_are_dealt_by_size(spark, monkeypatch):
    asked = _seen(monkeypatch, incremental)
    raw = _stored(spark)
    got = incremental.refresh_incremental_once(spark, [raw], as_of=AS_OF)
    files, a_trigger = asked[0]
    assert files > 2 and a_trigger == files // 2  # two micro-batches, as with two files
    assert got["vw_regional_sales"].first()["total_orders"] == 393
    assert [r["epoch"] for r in got["refused_orders"].collect()] == [0, 1]


def test_shuffles_of_a_batch_are_dealt_by_its_rows_and_the_store(spark, monkeypatch):
    monkeypatch.setattr(partitioning, "TASK_ROWS", 20)
    parts, change = [], incremental.signed_change

    def spy(old, new):
        out = change(old, new)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(incremental, "signed_change", spy)
    own, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    raw = _stored(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts would be joined
    try:
        got = incremental.refresh_incremental_once(spark, [raw], as_of=AS_OF)
        assert got["vw_regional_sales"].first()["total_orders"] == 393
        assert parts == [10, 20]  # 200 rows; 200 more, and as many in the store
        assert spark.conf.get("spark.sql.shuffle.partitions") == own
        incremental.apply_batch(raw, 0, scratch_path(spark, "direct"), as_of=AS_OF)  # in this session
        assert parts[2:] == [20] and spark.conf.get("spark.sql.shuffle.partitions") == own
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_joins_of_what_arrives_are_dealt_by_size(spark, monkeypatch):
    asked, into = [], incremental.shuffles_into
    monkeypatch.setattr(partitioning.parts_by_size, "__defaults__", (1000,))
    monkeypatch.setattr(incremental, "shuffles_into", lambda spark, parts: asked.append(parts) or into(spark, parts))
    raw = _stored(spark)
    incremental.refresh_incremental_once(spark, [raw], as_of=AS_OF)
    assert asked[0] == partitioning.parts_by_size(raw, 2) > 8


def test_a_session_gets_its_own_parts_back(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    with partitioning.shuffles_into(spark, 0):
        assert spark.conf.get("spark.sql.shuffle.partitions") == own
    try:
        with partitioning.shuffles_into(spark, partitioning.parts_by_rows(1_000_000_001)):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "2001"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get("spark.sql.shuffle.partitions") == own


def test_files_of_the_refresh_are_dealt_by_size(spark, monkeypatch):
    asked = _seen(monkeypatch, refresh)
    got = refresh.refresh_once(spark, _stored(spark), as_of=AS_OF)
    files, a_trigger = asked[0]
    assert files > 4 and a_trigger == files // 2  # two micro-batches
    assert sum(r["total_orders"] for r in got.collect()) == 393


def test_clean_orders_are_stored_where_they_are_read_twice(spark, monkeypatch):
    ensure_checkpoint_dir(spark)
    seen = {}
    monkeypatch.setattr(entry.cells, "build_cells", lambda clean: seen.setdefault("cells", clean))
    monkeypatch.setattr(entry.cells, "kpi_summary_from_cells", lambda built, spec: built)
    monkeypatch.setattr(entry.cells, "report_regional_from_cells", lambda built, spec: built)
    monkeypatch.setattr(entry, "export_csv", lambda clean, path: seen.setdefault("csv", clean) and path)
    monkeypatch.setattr(entry, "read_exported_orders", lambda spark, path: seen["csv"])
    for name in ("cells_kpi_filtered", "cells_report_regional", "export_csv_roundtrip"):
        seen.clear()
        entry.queries()[name](spark, entry.SF_SMOKE)
        clean = next(iter(seen.values()))
        assert "Join" not in clean._jdf.queryExecution().optimizedPlan().toString(), name
        assert not [f for f in clean.inputFiles() if "lineitem" in f], name


def test_the_widest_dimension_is_joined_last(spark, monkeypatch):
    from kpiforge.sources import orders

    monkeypatch.setattr(orders, "fits_broadcast_all", lambda frames: dict.fromkeys(frames, False))
    plan = conform_test_tables(spark, entry.SF_SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "l_orderkey" in joins[0] and "l_partkey" in joins[1]  # the last one comes first


def test_pages_are_cut_by_size(spark, monkeypatch):
    stored = _stored(spark)
    want = [tuple(r) for r in pages.write_pages(stored, parts=2).page(1, 100).collect()]
    monkeypatch.setattr(partitioning.parts_by_size, "__defaults__", (2000,))
    cut = pages.write_pages(stored, parts=2)
    assert cut.index.count() > 2
    assert [tuple(r) for r in cut.page(1, 100).collect()] == want


def test_views_of_a_refresh_come_from_one_pass(spark):
    from kpiforge.plans.rollup import order_rollup
    from kpiforge.plans.tables import OrderTables
    from kpiforge.plans.views import build_views

    rows = [
        order("A", "2000-01-10 10:30:00"), order("A", "2000-01-11 00:00:00"), order(None), order(None, region=None, customer=None),
        order("B", "2001-06-14 23:00:00", revenue=None), order("C", None, category=None, revenue=None), order("D", revenue="-3.00"),
        order("E", "2001-06-16 01:00:00", status="Pending", quantity=None), order("F", status=None, payment=None, region="South", customer=None),
    ]
    t = OrderTables(orders_df(spark, rows), as_of=AS_OF, materialized=True)
    rollup = materialize(order_rollup(t.clean), "rollup")
    plain, summed = build_views(t.raw, t.clean, AS_OF), build_views(t.raw, t.clean, AS_OF, t.deduped, rollup)
    assert plain.keys() == summed.keys()
    for name in plain:
        assert dict(plain[name].dtypes) == dict(summed[name].dtypes), name
        cols = plain[name].columns
        assert sorted(map(str, plain[name].select(cols).collect())) == sorted(map(str, summed[name].select(cols).collect())), name
    read = [n for n, df in summed.items() if any("deduped_orders" in f for f in df.inputFiles())]
    assert sorted(read) == ["vw_data_quality", "vw_regional_sales", "vw_top_orders"]


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}


def _gone_soon(look) -> bool:
    """Whether ``look()`` becomes empty; files are removed beside the job."""
    for _ in range(50):
        if not look():
            return True
        time.sleep(0.1)
    return False


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    spark.conf.unset(CLEANUP_CONF)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sums")
    assert _gone_soon(lambda: _shuffle_files(spark) - before)
    assert out.agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get(CLEANUP_CONF, None) is None  # the session's own setting is back
    with shuffles_dropped(spark):
        with shuffles_dropped(spark):
            pass
        assert spark.conf.get(CLEANUP_CONF) == "true"


def test_a_refresh_keeps_no_batch_twice(spark, monkeypatch):
    """At the last steps of a batch neither the arrived rows, nor the shuffles, nor files of batches before are there."""
    seen, write = [], incremental.write_tables

    def spy(tables, folder):
        state = os.path.dirname(os.path.dirname(folder))
        inbox = os.path.join(os.path.dirname(os.path.dirname(state)), "inbox")
        seen.append({*os.listdir(os.path.dirname(folder))} & {"arrived", "known", "copies", "change", "pairs", "seen"})
        seen[-1] |= {"rdd"} if spark.sparkContext._jsc.sc().getPersistentRDDs().size() > kept else set()
        files.append(len([f for f in os.listdir(inbox) if f.endswith(".parquet")]))
        return write(tables, folder)

    files, kept = [], spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    monkeypatch.setattr(incremental, "write_tables", spy)
    before = _shuffle_files(spark)
    raw = _stored(spark)
    got = incremental.refresh_incremental_once(spark, [raw], files=3, as_of=AS_OF)
    assert seen == [set()] * 3
    assert files[-1] < files[0]  # those of the first batch are gone
    assert _gone_soon(lambda: _shuffle_files(spark) - before)
    assert got["refused_orders"].agg(F.sum("raw_rows")).first()[0] == raw.count()
