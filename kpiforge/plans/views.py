"""The eight named KPI and quality views.

Each view is a DataFrame definition shared by the dashboard tables, the
report bundle and SQL users; ``register_views`` publishes them as temp
views so ``spark.sql("SELECT * FROM vw_regional_sales")`` works.
``vw_data_quality`` reads raw orders, the other seven read clean orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.expressions import as_of_literal
from kpiforge.operators import metrics
from kpiforge.operators.stats import named_counts, rows_of
from kpiforge.plans.rollup import region_customers, rollup_views
from kpiforge.schema import (
    DQ_DUPLICATE_IDS,
    DQ_FUTURE_DATES,
    DQ_MISSING_REVENUE,
    DQ_NEGATIVE_REVENUE,
)


def vw_data_quality(raw: DataFrame, as_of=None, deduped: DataFrame | None = None) -> DataFrame:
    """``[issue_type, issue_count, checked_at]``: four checks in one scan.

    The SQL original unions four scans of the table; here one aggregate
    computes all four counts (the distinct count is a two-level aggregate
    on ``order_id``) and the one summary row becomes four rows.  Duplicates
    follow the SQL formula ``COUNT(*) - COUNT(DISTINCT order_id)`` (every
    NULL id counts as a duplicate).  "Future" compares with the date of
    ``as_of`` (``CURRENT_DATE``).  With stored de-duplicated orders, which
    have every id once, the distinct ids are counted there without a shuffle.
    """
    today = F.to_date(as_of_literal(as_of)).cast("timestamp_ntz")
    if deduped is not None:
        of_raw = {
            "m": F.count_if(F.col("revenue").isNull()),
            "r": F.count(F.lit(1)),
            "f": F.count_if(F.col("order_date") > today),
            "n": F.count_if(F.col("revenue") < 0),
        }
        one = named_counts([(raw, of_raw), (deduped, {"i": F.count("order_id")})])
        return quality_rows(one, F.col("m"), F.col("r") - F.col("i"), F.col("f"), F.col("n"), as_of)
    one = raw.agg(
        F.count_if(F.col("revenue").isNull()).alias("m"),
        (F.count(F.lit(1)) - F.count_distinct("order_id")).alias("d"),
        F.count_if(F.col("order_date") > today).alias("f"),
        F.count_if(F.col("revenue") < 0).alias("n"),
    )
    return quality_rows(one, F.col("m"), F.col("d"), F.col("f"), F.col("n"), as_of)


def quality_rows(one: DataFrame, missing: Column, duplicates: Column, future: Column, negative: Column, as_of=None) -> DataFrame:
    """The four quality checks as rows, from a one-row frame of counts."""
    ts = as_of_literal(as_of)
    rows = [
        [F.lit(DQ_MISSING_REVENUE), missing, ts],
        [F.lit(DQ_DUPLICATE_IDS), duplicates, ts],
        [F.lit(DQ_FUTURE_DATES), future, ts],
        [F.lit(DQ_NEGATIVE_REVENUE), negative, ts],
    ]
    return rows_of(one, rows, ["issue_type", "issue_count", "checked_at"])


def build_views(
    raw: DataFrame, clean: DataFrame, as_of=None, deduped: DataFrame | None = None, rollup: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All eight views as DataFrames, keyed by view name.

    With a stored ``order_rollup`` of the clean orders all sums come from it,
    and the orders are read for the distinct customers and the top ones only;
    with stored ``deduped`` orders the distinct ids are counted there.
    """
    if rollup is not None:
        sums = rollup_views(rollup, region_customers(clean), metrics.top_completed(clean), as_of)
        return sums | {"vw_data_quality": vw_data_quality(raw, as_of, deduped)}
    return {
        "vw_revenue_trend": metrics.vw_revenue_trend(clean),
        "vw_category_performance": metrics.vw_category_performance(clean),
        "vw_regional_sales": metrics.vw_regional_sales(clean),
        "vw_order_status": metrics.vw_order_status(clean),
        "vw_payment_methods": metrics.vw_payment_methods(clean),
        "vw_data_quality": vw_data_quality(raw, as_of, deduped),
        "vw_top_orders": metrics.vw_top_orders(clean),
        "vw_daily_sales_30d": metrics.vw_daily_sales_30d(clean, as_of),
    }


def register_views(raw: DataFrame, clean: DataFrame, as_of=None) -> list[str]:
    """Register ``orders``, ``raw_orders`` and the eight views as temp views."""
    raw.createOrReplaceTempView("raw_orders")
    clean.createOrReplaceTempView("orders")
    views = build_views(raw, clean, as_of)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
