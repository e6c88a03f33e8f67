"""Benchmark: the ETL and the headline KPI queries at ``$BENCH_SF_DIR``.

Steps, as a production run would do them:

* ``conform_raw``: star join of the test tables into raw orders, written
  once to the shared checkpoint folder (the "load" of the source table);
* ``clean_orders``: exact category median, fill, keep-first dedup, negative
  drop over raw orders, written once (lineage cut);
* every view and report query over the written tables, executed with the
  ``noop`` sink (full execution, nothing collected).

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiforge.operators import cleaning, filters, metrics  # noqa: E402
from kpiforge.plans import cells, report, views  # noqa: E402
from kpiforge.plans.etl import run_etl  # noqa: E402
from kpiforge.plans.tables import FilterSpec, OrderTables  # noqa: E402
from kpiforge.session import build_session, materialize, scratch_path  # noqa: E402
from kpiforge.sinks.files import export_csv, write_bundle  # noqa: E402
from kpiforge.sources.orders import conform_test_tables  # noqa: E402
from kpiforge.streaming.incremental import refresh_incremental_once  # noqa: E402
from kpiforge.streaming.refresh import refresh_once  # noqa: E402

AS_OF = "2001-06-15 00:00:00"
REFRESH_BATCHES = 4
FILTER = FilterSpec(
    date_from="1996-01-01", date_to="1997-06-30", categories=["PROMO", "SMALL"],
    statuses=["Completed", "Cancelled", "Refunded"],
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def timed(fn, repeats: int = REPEATS):
    best, out = float("inf"), None
    for _ in range(repeats):
        t0 = time.perf_counter()
        out = fn()
        best = min(best, time.perf_counter() - t0)
    return out, best


def _sf_value(sf_dir: str):
    text = os.path.basename(sf_dir).replace("sf", "")
    try:
        return float(text)
    except ValueError:
        return text


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {}
    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")  # stage/task times, off by default
    if event_dir:
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir}
    spark = build_session(
        master=f"local[{cpus}]", shuffle_partitions=cpus, app_name="kpiforge-bench", extra=extra
    )
    # warm the JVM (class loading, codegen caches) on a throwaway query
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}
    raw, times["conform_raw"] = timed(lambda: materialize(conform_test_tables(spark, sf_dir), "raw_orders"))
    def build_clean():
        spark.catalog.clearCache()  # no median summaries reused across repeats
        t = OrderTables(raw, as_of=AS_OF, filters=FILTER, materialized=True)
        return t, t.clean

    (t, clean), times["clean_orders"] = timed(build_clean)

    vw = views.build_views(raw, clean, AS_OF)
    filtered = t.filtered
    steps = {
        **{name: df for name, df in vw.items()},
        "kpi_summary": metrics.kpi_summary(clean),
        "kpi_filtered": metrics.kpi_summary(filtered),
        "kpi_delta": metrics.kpi_delta(clean, "2000-07-01", "2000-09-30"),
        "revenue_by_month": metrics.revenue_by_month(clean),
        "category_region_pivot": lambda: metrics.category_region_pivot(clean),  # sums its cells when it is built: built while timed
        "region_revenue_share": metrics.region_revenue_share(clean),
        "status_distribution": metrics.status_distribution(clean),
        "filter_domains": filters.filter_domains(clean),
        "null_profile": cleaning.null_profile(raw),
        "issue_log": t.issues,
        "report_regional": metrics.report_regional(filtered),
        "report_category": metrics.report_category(filtered),
        "preview_orders": metrics.preview_orders(clean),
    }
    for name, df in steps.items():
        _, times[name] = timed(lambda df=df: run(df() if callable(df) else df))

    total = sum(times.values())  # the steps of earlier rounds; those below are reported beside it
    built: list = []
    extra_steps = {
        "batch_job": lambda: run_etl(raw, scratch_path(spark, "bench_etl"), as_of=AS_OF, filters=FILTER),
        "export_csv": lambda: export_csv(filtered, scratch_path(spark, "bench_csv")),
        "report_bundle": lambda: write_bundle(report.report_tables(t), scratch_path(spark, "bench_bundle"), "bench"),
        # the same number of micro-batches each, so that history grows under both
        "refresh_exact": lambda: run(refresh_once(spark, raw, as_of=AS_OF, files=REFRESH_BATCHES, files_per_batch=1)),
        "refresh_incremental": lambda: refresh_incremental_once(spark, [raw], files=REFRESH_BATCHES, as_of=AS_OF),
        "cells_build": lambda: built.append(cells.build_cells(clean)),
        "cells_kpi_filtered": lambda: run(cells.kpi_summary_from_cells(built[0], FILTER)),
        "cells_report_regional": lambda: run(cells.report_regional_from_cells(built[0], FILTER)),
    }
    for name, fn in extra_steps.items():
        _, times[name] = timed(fn, 1)

    print(
        json.dumps(
            {
                "metric": "kpi_etl_and_reports_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": _sf_value(sf_dir),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
