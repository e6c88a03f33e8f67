"""Sums over any window of days as the difference of two rows.

The rollup's sums are added up along the days of every (category, region,
status) cell, with a row for each day between the first and the last.  The
sums of a window are then those at its end less those before its start: two
rows a cell, found by a pushed date filter, however long the window is.
Distinct customers, which have no difference, come from the bitmaps of
``plans.cells``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.expressions import exact_ratio, money, pct
from kpiforge.operators.filters import as_date
from kpiforge.operators.metrics import KPI_ORDER, delta_rows, previous_window
from kpiforge.plans.cells import CELL, Cells, distinct_customers
from kpiforge.plans.tables import FilterSpec
from kpiforge.schema import CANCELLED, COMPLETED, DAILY_WINDOW_DAYS
from kpiforge.session import materialize

SUMS = ["rows", "orders", "priced", "revenue"]
_DAY = dt.timedelta(days=1)


@dataclass
class Prefix:
    """``table``: ``sale_date``, the cell and the sums of all its days up to that one; None without a dated order."""

    table: DataFrame
    first: dt.date | None
    last: dt.date | None


def build_prefix(rollup: DataFrame) -> Prefix:
    """Prefix rows of ``order_rollup``'s sums, written; rows without a date belong to no window."""
    typed = [F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,4)" if c == "revenue" else "long").alias(c) for c in SUMS]
    sums = rollup.where(F.col("sale_date").isNotNull()).select("sale_date", *CELL, *typed)
    first, last = sums.agg(F.min("sale_date"), F.max("sale_date")).first()
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("sale_date")
    grid = sums.select(*CELL).distinct().select(days, *CELL, *[F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in SUMS])
    dense = sums.unionByName(grid).groupBy("sale_date", *CELL).agg(*[F.sum(c).alias(c) for c in SUMS])
    upto = Window.partitionBy(*CELL).orderBy("sale_date").rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    table = dense.select("sale_date", *CELL, *[F.sum(c).over(upto).alias(c) for c in SUMS])
    return Prefix(materialize(table, "prefix", sort_within=["sale_date"]), first, last)


def window_sums(prefix: Prefix, date_from, date_to, *keys: str) -> DataFrame:
    """``keys`` and SUMS over the days from ``date_from`` to ``date_to``, both included."""

    def upto(day: dt.date) -> dt.date | None:
        """The day whose prefix row holds everything up to ``day``; None if that is nothing."""
        return None if prefix.first is None or day < prefix.first else min(day, prefix.last)

    f, t = as_date(date_from), as_date(date_to)
    high, low = upto(t), upto(f - _DAY)
    if high is None or f > t or high == low:
        rows, sign = prefix.table.limit(0), F.lit(1)
    else:
        rows = prefix.table.where(F.col("sale_date").isin([d for d in (high, low) if d is not None]))
        sign = F.when(F.col("sale_date") == F.lit(high), 1).otherwise(-1)
    return rows.select(*keys, *[(sign * F.col(c)).alias(c) for c in SUMS]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def _kpis(prefix: Prefix, cells: Cells, date_from, date_to, p: str) -> DataFrame:
    """The six KPIs of a window as one row of DOUBLE columns ``<p>_*``."""
    by_status = window_sums(prefix, date_from, date_to, "status")
    total = lambda c, cond=F.lit(True): F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    done, cancelled = F.col("status") == COMPLETED, F.col("status") == CANCELLED
    one = by_status.agg(
        total("revenue", done).alias("revenue"), total("priced", done).alias("priced"), total("rows").alias("rows"),
        total("rows", cancelled).alias("cancelled"), total("rows", done).alias("done"),
    )
    people = distinct_customers(cells, FilterSpec(date_from=date_from, date_to=date_to))
    one = one.withColumn("_one", F.lit(1)).join(people.withColumn("_one", F.lit(1)), "_one")  # one row each
    kpis = {
        "total_revenue": money("revenue"),
        "total_orders": F.col("rows"),
        "avg_order_value": exact_ratio(F.col("revenue"), F.col("priced"), 4),
        "cancellation_rate": pct(F.col("cancelled"), F.col("rows")),
        "completed_orders": F.col("done"),
        "unique_customers": F.col("people"),
    }
    return one.select(*[kpis[k].cast("double").alias(f"{p}_{k}") for k in KPI_ORDER])


def kpi_delta_from_prefix(prefix: Prefix, cells: Cells, date_from, date_to) -> DataFrame:
    """``metrics.kpi_delta`` without the orders, for any window."""
    f, t = as_date(date_from), as_date(date_to)
    both = [_kpis(prefix, cells, a, b, p).withColumn("_one", F.lit(1)) for p, (a, b) in (("c", (f, t)), ("p", previous_window(f, t)))]
    return delta_rows(both[0].join(both[1], "_one").drop("_one"))


def daily_sales_from_prefix(prefix: Prefix, as_of) -> DataFrame:
    """``vw_daily_sales_30d`` from prefix rows: each day less the day before, from the first day of the window on."""
    start = as_date(str(as_of)[:10]) - dt.timedelta(days=DAILY_WINDOW_DAYS)
    done = prefix.table.where((F.col("status") == COMPLETED) & (F.col("sale_date") >= F.lit(start - _DAY)))
    days = done.groupBy("sale_date").agg(*[F.sum(c).alias(c) for c in SUMS])
    by_day = Window.partitionBy().orderBy("sale_date")  # a row per day of the window
    # the day before the first one of the table has no row and no sums
    step = {c: F.col(c) - F.coalesce(F.lag(c).over(by_day), F.lit(0)) for c in SUMS}
    out = days.select("sale_date", *[v.alias(c) for c, v in step.items()]).where((F.col("sale_date") >= F.lit(start)) & (F.col("rows") > 0))
    return out.select("sale_date", F.col("orders"), money(F.when(F.col("priced") > 0, F.col("revenue"))).alias("daily_revenue")).orderBy("sale_date")
