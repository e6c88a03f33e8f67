"""Refresh job: ``python -m kpiforge.streaming --inbox <dir> --out <dir> [options]``.

Runs until stopped (``processingTime`` trigger, default every 5 minutes),
or drains what is in the inbox and exits with ``--available-now``.  The
session takes its settings from the cluster; the stream's progress is
kept in ``<out>/_checkpoint`` so a restarted job resumes.  The tables of
the last finished batch are those that ``<out>/tables/current.json`` names
(``kpiforge.sinks.versions.published``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kpiforge.session import checkpoint_root
from kpiforge.streaming.incremental import start_incremental_refresh
from kpiforge.streaming.refresh import start_refresh


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="kpiforge.streaming", description="refresh the KPI tables")
    p.add_argument("--inbox", required=True, help="folder where new order files (Parquet) land")
    p.add_argument("--out", required=True, help="folder for the store, tables and checkpoint")
    p.add_argument("--mode", choices=["exact", "incremental"], default="exact")
    p.add_argument("--medians", help="category_median table to fill from (incremental mode; default: medians of all rows that have arrived)")
    p.add_argument("--as-of", default=None)
    p.add_argument("--every", default="5 minutes", help="trigger interval")
    p.add_argument("--approx-customers", action="store_true", help="HLL customer counts (incremental mode)")
    p.add_argument("--max-files-per-trigger", type=int, default=None)
    p.add_argument("--available-now", action="store_true", help="drain the inbox and stop")
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName(f"kpiforge-refresh-{args.mode}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)  # fail fast without a shared checkpoint folder
    out = args.out.rstrip("/")
    if args.mode == "exact":
        query = start_refresh(
            spark, args.inbox, f"{out}/store", f"{out}/tables", f"{out}/_checkpoint",
            as_of=args.as_of, processing_time=args.every, available_now=args.available_now,
            max_files_per_trigger=args.max_files_per_trigger,
        )
    else:
        query = start_incremental_refresh(
            spark, args.inbox, f"{out}/tables", f"{out}/_checkpoint", args.medians,
            as_of=args.as_of, approx_customers=args.approx_customers, processing_time=args.every,
            available_now=args.available_now, max_files_per_trigger=args.max_files_per_trigger,
        )
    query.awaitTermination()
    if query.exception() is not None:
        raise SystemExit(str(query.exception()))
    return f"{out}/tables"


if __name__ == "__main__":
    print(main())
