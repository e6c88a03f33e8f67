"""Write PLANS.md: physical plans of the headline queries.

    python tools/explain_plans.py [sf_dir]

The plans are Spark's physical plans before adaptive re-planning (AQE
may still coalesce partitions or switch a join at runtime).  Only the
operator tree and the scan lines (location, pushed filters, read schema)
are kept.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from kpiforge.operators import cleaning, filters, metrics  # noqa: E402
from kpiforge.plans import cells, pages, prefix, views  # noqa: E402
from kpiforge.plans.rollup import order_rollup  # noqa: E402
from kpiforge.plans.tables import FilterSpec, OrderTables  # noqa: E402
from kpiforge.session import build_session, ensure_checkpoint_dir, materialize, scratch_path  # noqa: E402
from kpiforge.sources import bucketed, footers  # noqa: E402
from kpiforge.sources.orders import conform_test_tables  # noqa: E402
from kpiforge.streaming import incremental, keyed_store  # noqa: E402
from kpiforge.streaming.keyed_store import KeyedStore  # noqa: E402

AS_OF = "2001-06-15 00:00:00"
SOME = FilterSpec(date_from="1996-02-10", date_to="1997-06-30", categories=["PROMO"])


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    keep = [
        line
        for line in details.splitlines()
        if re.match(r"^\(\d+\) Scan ", line)
        or line.startswith(("Location:", "PushedFilters:", "ReadSchema:", "PartitionFilters:", "PushedAggregation:"))
    ]
    keep = [re.sub(r"kpiforge/[\w-]+-[0-9a-f]{32}", "kpiforge/<table>", k) for k in keep]
    return tree.strip() + ("\n\n" + "\n".join(keep) if keep else "")


def looked_up(spark, raw):
    """The look-up of a small batch's ids in the store of the incremental refresh (buckets that its Bloom filters let through)."""
    ensure_checkpoint_dir(spark)
    keyed_store.BUCKET_ROWS = 1000  # several buckets on a small table
    store = KeyedStore(spark, scratch_path(spark, "store"), "ids", ["order_id"], raw.schema)
    runs = [store.write(incremental.possible_copies(raw), 0)]
    few = store.hashed(raw.select("order_id").orderBy("order_id").limit(3).distinct())
    return store.look_up(runs, few)


def with_day(spark, clean):
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "with_day")
    footers.write_with_day(clean, path)
    return path


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    conformed = conform_test_tables(spark, sf_dir)
    raw = materialize(conformed, "raw_orders")
    t = OrderTables(raw, as_of=AS_OF, materialized=True)
    clean = t.clean
    built = cells.build_cells(clean)
    sections = [
        ("conform test tables (fact streamed, dimensions broadcast after a count)", conformed),
        ("keep-first dedup (partial WindowGroupLimit before the shuffle)", cleaning.dedup_orders(raw)),
        ("category median: the one pass over raw orders (histogram)", raw.groupBy("category", F.col("revenue").cast("double").alias("v")).count()),
        ("median fill (size-checked broadcast of the median table)", cleaning.fill_missing_median(raw, t.medians)),
        ("vw_data_quality (four checks, one scan)", views.vw_data_quality(raw, AS_OF)),
        ("vw_top_orders (TakeOrderedAndProject)", metrics.vw_top_orders(clean)),
        ("vw_regional_sales (two-level distinct count)", metrics.vw_regional_sales(clean)),
        (
            "filter on the written table (pushed filters, pruned columns)",
            metrics.kpi_summary(filters.filter_orders(clean, "1996-01-01", "1996-12-31", categories=["PROMO"])),
        ),
        ("category x region pivot", metrics.category_region_pivot(clean)),
        ("day-grain rollup (batch job, incremental refresh)", order_rollup(clean)),
        ("incremental refresh: rows of a batch that can be kept", incremental.possible_copies(raw)),
        ("incremental refresh: look-up of a batch's ids (partition filters on buckets)", looked_up(spark, raw)),
        ("keep-first dedup of a bucketed table (no exchange)", cleaning.dedup_orders(bucketed.scratch_table(raw, "by_id", 8))),
        ("date bounds from footers (pushed aggregation)", footers.table_bounds(spark, with_day(spark, clean))),
        ("filtered KPIs from cells (no orders)", cells.kpi_summary_from_cells(built, SOME)),
        ("sums of a window from two prefix rows a cell", prefix.window_sums(prefix.build_prefix(built.rollup), "2000-07-01", "2000-09-30", "status")),
        ("a middle page of the preview (partition filter)", pages.write_pages(clean).page(3)),
        ("kpi_delta (both windows in one scan)", metrics.kpi_delta(clean, "2000-07-01", "2000-09-30")),
        ("issue log (two scans: raw, deduplicated)", t.issues),
    ]
    out = [
        "# Physical plans of the headline queries",
        "",
        f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local[8], 8 shuffle partitions, AQE on).",
        "Plans are shown before adaptive re-planning (AQE may still coalesce partitions or switch",
        "a join at runtime); scan details are trimmed to location, pushed filters and read schema.",
        "",
    ]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
