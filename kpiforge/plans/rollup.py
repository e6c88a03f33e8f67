"""Day-grain rollup of clean orders, and the views that are sums over it.

One pass over the clean orders gives rows, orders, priced rows, revenue and
units per (day, category, region, payment method, status).  Every view but
the distinct customers and the top orders is a sum over that small table, so
a batch or a refresh reads the orders once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.expressions import as_of_literal, exact_ratio, money, month_start, pct
from kpiforge.operators import metrics
from kpiforge.schema import COMPLETED, DAILY_WINDOW_DAYS

ROLLUP_KEYS = ["sale_date", "category", "region", "payment_method", "status"]
ROLLUP_SUMS = ["rows", "orders", "priced", "revenue", "units"]


def order_rollup(clean: DataFrame) -> DataFrame:
    """Sums per day, category, region, payment method and status."""
    return clean.groupBy(
        F.to_date("order_date").alias("sale_date"), "category", "region", "payment_method", "status"
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("order_id").alias("orders"),
        F.count("revenue").alias("priced"),
        F.sum("revenue").cast("decimal(28,4)").alias("revenue"),
        F.sum("quantity").alias("units"),
    )


def add_up(rollup: DataFrame, *keys) -> DataFrame:
    """The rollup's sums per ``keys``."""
    return rollup.groupBy(*keys).agg(
        *[(F.sum(c).cast("decimal(28,4)") if c == "revenue" else F.sum(c)).alias(c) for c in ROLLUP_SUMS]
    )


def _avg() -> Column:
    return exact_ratio(F.col("revenue"), F.col("priced"), 4)


def _largest_first(key: str) -> list[Column]:
    return [F.col("total_revenue").desc_nulls_first(), F.col(key).asc_nulls_last()]


def rollup_views(rollup: DataFrame, customers: DataFrame, top: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Seven views from the rollup, ``customers(region, unique_customers)`` and the top orders' candidates."""
    done = rollup.where(F.col("status") == COMPLETED)
    orders, revenue = F.col("orders").alias("total_orders"), money("revenue").alias("total_revenue")
    average = _avg().alias("avg_order_value")
    start = F.date_sub(F.to_date(as_of_literal(as_of)), DAILY_WINDOW_DAYS)
    by_status = add_up(rollup, "status").select("status", F.col("orders").alias("order_count"))
    regional = add_up(rollup, "region").join(
        customers.withColumnRenamed("region", "_r"), F.col("region").eqNullSafe(F.col("_r")), "left"
    )
    return {
        "vw_revenue_trend": add_up(done, month_start("sale_date").alias("month"))
        .select("month", revenue, orders, average)
        .orderBy(F.col("month").asc_nulls_last()),
        "vw_category_performance": add_up(done, "category")
        .select("category", orders, revenue, average, F.col("units").alias("total_units_sold"))
        .orderBy(*_largest_first("category")),
        "vw_regional_sales": regional.select("region", orders, revenue, average, "unique_customers").orderBy(
            *_largest_first("region")
        ),
        "vw_order_status": by_status.withColumn(
            "pct_share", pct(F.col("order_count"), F.sum("order_count").over(Window.partitionBy()))
        ),
        "vw_payment_methods": add_up(done, "payment_method")
        .select("payment_method", orders, revenue)
        .orderBy(*_largest_first("payment_method")),
        "vw_top_orders": metrics.vw_top_orders(top),
        "vw_daily_sales_30d": add_up(done.where(F.col("sale_date") >= start), "sale_date")
        .select("sale_date", F.col("orders"), money("revenue").alias("daily_revenue"))
        .orderBy(F.col("sale_date").asc_nulls_last()),
    }


def region_customers(pairs: DataFrame) -> DataFrame:
    """``(region, unique_customers)`` from rows or distinct pairs of region and customer."""
    return pairs.groupBy("region").agg(F.count_distinct("customer_id").alias("unique_customers"))
