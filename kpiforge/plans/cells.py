"""Filtered KPIs from cells alone, distinct customers included.

``build_cells`` reads the clean orders once and writes four tables:

* ``rollup``: sums per (day, category, region, payment method, status).
* ``customers``: the dictionary, a dense number for every customer, dealt in
  hash buckets with offsets (no single task numbers them all).
* ``months``: per (month, category, region, status) the customers as bitmaps
  of 32,768 numbers (``bitmap_construct_agg``).  Bitmaps add up with OR,
  which counts do not.
* ``days``: per (day, category, region, status) the numbers as lists, for
  the days of a date range that do not fill a month.

Any of the report filters is then answered from these tables: whole months
by OR of their bitmaps, the few days at either end by their lists.  Orders
are not read again, whatever a user picks.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.expressions import exact_ratio, money, pct
from kpiforge.operators.filters import as_date, in_list
from kpiforge.plans.rollup import add_up, order_rollup
from kpiforge.plans.tables import FilterSpec
from kpiforge.schema import CANCELLED, COMPLETED, HEAD_REGIONAL
from kpiforge.session import materialize

# Hash buckets of the dictionary; each is numbered by one task.
DICTIONARY_BUCKETS = 256
CELL = ["category", "region", "status"]


@dataclass
class Cells:
    rollup: DataFrame
    customers: DataFrame
    months: DataFrame
    days: DataFrame


def number_customers(pairs: DataFrame, buckets: int = DICTIONARY_BUCKETS) -> DataFrame:
    """``(customer_id, number)``: 1, 2, ... for the distinct customers, the same on every run."""
    bucket = F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")
    distinct = materialize(pairs.where(F.col("customer_id").isNotNull()).select("customer_id").distinct().withColumn("bucket", bucket), "customers")
    sizes = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # a row per bucket
    before = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("customer_id"))
    return distinct.join(F.broadcast(starts), "bucket").select("customer_id", (F.col("start") + inside).alias("number"))


def build_cells(clean: DataFrame) -> Cells:
    """Write the four tables to the shared checkpoint folder."""
    rollup = materialize(order_rollup(clean), "cells_rollup", sort_within=["sale_date"])
    pairs = clean.where(F.col("customer_id").isNotNull()).select(F.to_date("order_date").alias("sale_date"), *CELL, "customer_id")
    pairs = materialize(pairs.distinct(), "cells_pairs")  # a hot customer has a row per day and cell at most
    customers = materialize(number_customers(pairs), "cells_customers")
    numbered = pairs.join(customers, "customer_id").select("sale_date", *CELL, "number")
    numbered = numbered.withColumn("bucket", F.bitmap_bucket_number("number"))
    days = numbered.groupBy("sale_date", *CELL, "bucket").agg(F.collect_set("number").alias("numbers"))  # 32,768 at most
    days = materialize(days, "cells_days", sort_within=["sale_date"])
    at = F.explode("numbers").alias("number")
    months = days.select(F.trunc("sale_date", "month").alias("month"), *CELL, "bucket", at)
    months = months.groupBy("month", *CELL, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
    return Cells(rollup, customers, materialize(months, "cells_months", sort_within=["month"]), days)


def _ends(filters: FilterSpec) -> tuple[dt.date | None, dt.date | None]:
    return (as_date(filters.date_from) if filters.date_from is not None else None, as_date(filters.date_to) if filters.date_to is not None else None)


def _between(column: str, first: dt.date | None, last: dt.date | None) -> Column:
    out = F.lit(True)
    if first is not None:
        out = out & (F.col(column) >= F.lit(first))
    if last is not None:
        out = out & (F.col(column) <= F.lit(last))
    return out


def _lists(df: DataFrame, filters: FilterSpec) -> DataFrame:
    for column, values in (("category", filters.categories), ("region", filters.regions), ("status", filters.statuses)):
        wanted = in_list(column, values)
        df = df if wanted is None else df.where(wanted)
    return df


def whole_months(first: dt.date | None, last: dt.date | None) -> tuple[dt.date | None, dt.date | None]:
    """First and last month (their first days) that lie inside the range; open ends stay open."""
    if first is not None and first.day > 1:
        first = (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    if last is not None:
        month = last.replace(day=1)
        last = month if last.day == calendar.monthrange(last.year, last.month)[1] else (month - dt.timedelta(days=1)).replace(day=1)
    return first, last


def filtered_rollup(cells: Cells, filters: FilterSpec) -> DataFrame:
    return _lists(cells.rollup.where(_between("sale_date", *_ends(filters))), filters)


def filtered_bitmaps(cells: Cells, filters: FilterSpec, *keys: str) -> DataFrame:
    """Customers of the filtered orders as one bitmap per (``keys``, bucket)."""
    first, last = _ends(filters)
    low, high = whole_months(first, last)
    months = _lists(cells.months.where(_between("month", low, high)), filters).select(*keys, "bucket", "bitmap")
    if low is not None and high is not None and low > high:  # no whole month inside
        months, at_ends = months.where(F.lit(False)), F.lit(True)
    else:
        at_ends = F.lit(False)
        if low is not None:
            at_ends = at_ends | (F.col("sale_date") < F.lit(low))
        if high is not None:
            at_ends = at_ends | (F.col("sale_date") > F.last_day(F.lit(high)))
    days = _lists(cells.days.where(_between("sale_date", first, last) & at_ends), filters)
    days = days.select(*keys, "bucket", F.explode("numbers").alias("number"))
    days = days.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
    return months.unionByName(days).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_customers(cells: Cells, filters: FilterSpec, *keys: str) -> DataFrame:
    """``keys`` and the number of distinct customers as ``people``."""
    return filtered_bitmaps(cells, filters, *keys).groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("people"))


def kpi_summary_from_cells(cells: Cells, filters: FilterSpec) -> DataFrame:
    """The six KPIs of the filtered orders: ``metrics.kpi_summary`` without the orders."""
    done, cancelled = F.col("status") == COMPLETED, F.col("status") == CANCELLED
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    sums = filtered_rollup(cells, filters).agg(
        total("revenue", done).alias("revenue"),
        total("priced", done).alias("priced"),
        total("rows", F.lit(True)).alias("rows"),
        total("rows", cancelled).alias("cancelled"),
        total("rows", done).alias("done"),
    )
    one = sums.withColumn("_one", F.lit(1)).join(distinct_customers(cells, filters).withColumn("_one", F.lit(1)), "_one")  # one row each
    return one.select(
        money("revenue").alias("total_revenue"),
        F.col("rows").alias("total_orders"),
        exact_ratio(F.col("revenue"), F.col("priced"), 4).alias("avg_order_value"),
        pct(F.col("cancelled"), F.col("rows")).alias("cancellation_rate"),
        F.col("done").alias("completed_orders"),
        F.col("people").alias("unique_customers"),
    )


def report_regional_from_cells(cells: Cells, filters: FilterSpec) -> DataFrame:
    """Orders, revenue and unique customers per region: ``metrics.report_regional`` without the orders."""
    h = HEAD_REGIONAL
    known = F.col("region").isNotNull()
    sums = add_up(filtered_rollup(cells, filters).where(known), "region")
    both = sums.join(distinct_customers(cells, filters, "region").where(known), "region", "left")
    return both.select(
        F.col("region").alias(h[0]),
        F.col("orders").alias(h[1]),
        money(F.coalesce("revenue", F.lit(0))).alias(h[2]),
        F.coalesce("people", F.lit(0)).alias(h[3]),
    ).orderBy(F.col(f"`{h[2]}`").desc_nulls_last(), F.col(f"`{h[0]}`"))
