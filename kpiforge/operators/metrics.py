"""KPI and report aggregates over (clean) orders.

Two families with different missing-value rules, as in the reference:

* dashboard / report tables (pandas semantics): NULL group keys are
  dropped, an empty sum is 0, an empty mean is NULL, sorts put missing
  values last;
* SQL views (``vw_*``): NULL group keys are kept, an empty sum is NULL,
  ``ORDER BY ... DESC`` puts NULLs first.

Every aggregate is a partial + final hash aggregate (map-side combine), so
a hot group costs one partial row per task.  Money is summed as DECIMAL and
published as ``round(x, 2)`` DOUBLE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.expressions import (
    as_of_literal,
    avg_money,
    exact_ratio,
    money,
    month_start,
    month_text,
    pandas_sum,
    pct,
    ts_literal,
)
from kpiforge.operators.filters import as_date
from kpiforge.operators.stats import rows_of
from kpiforge.session import materialize
from kpiforge.schema import (
    CANCELLED,
    COMPLETED,
    DAILY_WINDOW_DAYS,
    DEDUP_ORDER,
    HEAD_CATEGORY,
    HEAD_REGIONAL,
    HEAD_TREND,
    KPI_LABELS,
    PREVIEW_LIMIT,
    TOP_ORDERS_LIMIT,
)

def is_completed() -> Column:
    return F.col("status") == COMPLETED


def is_cancelled() -> Column:
    return F.col("status") == CANCELLED


def completed(df: DataFrame) -> DataFrame:
    return df.where(is_completed())


def _known(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows whose group key is missing (pandas ``groupby`` rule)."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


# --- KPI summary ---------------------------------------------------------------

def distinct_count(c: Column, approx_rsd: float | None = None) -> Column:
    """Exact distinct count, or an HLL estimate with relative error ``approx_rsd``."""
    return F.approx_count_distinct(c, approx_rsd) if approx_rsd else F.count_distinct(c)


def kpi_aggregates(cond: Column | None = None, approx_rsd: float | None = None) -> dict[str, Column]:
    """The six KPIs as aggregate expressions, optionally over rows where ``cond``.

    ``approx_rsd`` (off by default) replaces the exact unique-customer count
    by an HLL estimate: one partial aggregate instead of a two-level one.
    """
    base = F.lit(True) if cond is None else cond
    rows = F.count_if(base)
    return {
        "total_revenue": money(pandas_sum(F.when(base & is_completed(), F.col("revenue")))),
        "total_orders": rows,
        "avg_order_value": avg_money(F.when(base & is_completed(), F.col("revenue"))),
        "cancellation_rate": pct(F.count_if(base & is_cancelled()), rows),
        "completed_orders": F.count_if(base & is_completed()),
        "unique_customers": distinct_count(F.when(base, F.col("customer_id")), approx_rsd),
    }


KPI_ORDER = [
    "total_revenue",
    "total_orders",
    "avg_order_value",
    "cancellation_rate",
    "completed_orders",
    "unique_customers",
]


def kpi_summary(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """One row: total revenue and AOV (Completed), orders, cancellation %,
    completed orders, unique customers; one pass with conditional aggregates."""
    aggs = kpi_aggregates(approx_rsd=approx_rsd)
    return df.agg(*[aggs[k].alias(k) for k in KPI_ORDER])


# --- monthly -------------------------------------------------------------------

def revenue_by_month(df: DataFrame) -> DataFrame:
    """``[month 'YYYY-MM', total_revenue]`` of Completed orders, by month."""
    return (
        _known(completed(df).withColumn("month", month_text("order_date")), "month")
        .groupBy("month")
        .agg(money(pandas_sum("revenue")).alias("total_revenue"))
        .orderBy("month")
    )


def report_revenue_trend(df: DataFrame) -> DataFrame:
    """Report sheet: month text, revenue, orders (Completed), by month."""
    return (
        _known(completed(df).withColumn("_m", month_text("order_date")), "_m")
        .groupBy("_m")
        .agg(
            money(pandas_sum("revenue")).alias(HEAD_TREND[1]),
            F.count("order_id").alias(HEAD_TREND[2]),
        )
        .orderBy("_m")
        .withColumnRenamed("_m", HEAD_TREND[0])
    )


def vw_revenue_trend(df: DataFrame) -> DataFrame:
    """View: month start, revenue, orders, AOV of Completed orders."""
    return (
        completed(df)
        .groupBy(month_start("order_date").alias("month"))
        .agg(
            money(F.sum("revenue")).alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
            avg_money("revenue").alias("avg_order_value"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


# --- category ------------------------------------------------------------------

def revenue_by_category(df: DataFrame) -> DataFrame:
    """``[category, revenue]`` of Completed orders, largest first."""
    return (
        _known(completed(df), "category")
        .groupBy("category")
        .agg(money(pandas_sum("revenue")).alias("revenue"))
        .orderBy(F.col("revenue").desc_nulls_last(), "category")
    )


def aov_by_category(df: DataFrame) -> DataFrame:
    """``[category, avg_order_value]`` of Completed orders."""
    return (
        _known(completed(df), "category")
        .groupBy("category")
        .agg(avg_money("revenue").alias("avg_order_value"))
        .orderBy("category")
    )


def vw_category_performance(df: DataFrame) -> DataFrame:
    """View: orders, revenue, AOV, units per category (Completed)."""
    return (
        completed(df)
        .groupBy("category")
        .agg(
            F.count("order_id").alias("total_orders"),
            money(F.sum("revenue")).alias("total_revenue"),
            avg_money("revenue").alias("avg_order_value"),
            F.sum("quantity").alias("total_units_sold"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category").asc_nulls_last())
    )


def report_category(df: DataFrame) -> DataFrame:
    """Report sheet: category performance with display headings."""
    h = HEAD_CATEGORY
    return (
        _known(completed(df), "category")
        .groupBy(F.col("category").alias(h[0]))
        .agg(
            F.count("order_id").alias(h[1]),
            money(pandas_sum("revenue")).alias(h[2]),
            avg_money("revenue").alias(h[3]),
            pandas_sum("quantity").alias(h[4]),
        )
        .orderBy(F.col(f"`{h[2]}`").desc_nulls_last(), F.col(f"`{h[0]}`"))
    )


# --- region --------------------------------------------------------------------

def orders_by_region(df: DataFrame) -> DataFrame:
    """``[region, total_orders, total_revenue]`` over all statuses."""
    return (
        _known(df, "region")
        .groupBy("region")
        .agg(
            F.count("order_id").alias("total_orders"),
            money(pandas_sum("revenue")).alias("total_revenue"),
        )
        .orderBy("region")
    )


def report_regional(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Report sheet: orders, revenue, unique customers per region.

    The distinct count is planned as a two-level aggregate keyed on
    (region, customer_id), so a hot region spreads over many tasks.
    """
    h = HEAD_REGIONAL
    return (
        _known(df, "region")
        .groupBy(F.col("region").alias(h[0]))
        .agg(
            F.count("order_id").alias(h[1]),
            money(pandas_sum("revenue")).alias(h[2]),
            distinct_count(F.col("customer_id"), approx_rsd).alias(h[3]),
        )
        .orderBy(F.col(f"`{h[2]}`").desc_nulls_last(), F.col(f"`{h[0]}`"))
    )


def vw_regional_sales(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """View: orders, revenue, rounded AOV, unique customers per region."""
    return (
        df.groupBy("region")
        .agg(
            F.count("order_id").alias("total_orders"),
            money(F.sum("revenue")).alias("total_revenue"),
            avg_money("revenue").alias("avg_order_value"),
            distinct_count(F.col("customer_id"), approx_rsd).alias("unique_customers"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("region").asc_nulls_last())
    )


def region_revenue_share(df: DataFrame) -> DataFrame:
    """``[region, total_revenue, revenue_share_pct]`` over all statuses.

    The share divides each region's sum by the sum over the few grouped
    rows (a window over the aggregate output, not over orders).
    """
    g = _known(df, "region").groupBy("region").agg(pandas_sum("revenue").alias("_s"))
    total = F.sum("_s").over(Window.partitionBy())
    return g.select(
        "region",
        money("_s").alias("total_revenue"),
        exact_ratio(F.col("_s") * 100, total, 4, 4).alias("revenue_share_pct"),
    ).orderBy("region")


# --- status and payment ---------------------------------------------------------

def status_distribution(df: DataFrame) -> DataFrame:
    """``[status, orders]``: rows per status, most frequent first."""
    return (
        _known(df, "status")
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.col("orders").desc(), "status")
    )


def vw_order_status(df: DataFrame) -> DataFrame:
    """View: orders per status and their percent share of all orders."""
    g = df.groupBy("status").agg(F.count("order_id").alias("order_count"))
    return g.withColumn(
        "pct_share", pct(F.col("order_count"), F.sum("order_count").over(Window.partitionBy()))
    )


def revenue_by_payment(df: DataFrame) -> DataFrame:
    """``[payment_method, revenue]`` of Completed orders, smallest first."""
    return (
        _known(completed(df), "payment_method")
        .groupBy("payment_method")
        .agg(money(pandas_sum("revenue")).alias("revenue"))
        .orderBy(F.col("revenue").asc_nulls_last(), "payment_method")
    )


def vw_payment_methods(df: DataFrame) -> DataFrame:
    """View: orders and revenue per payment method (Completed)."""
    return (
        completed(df)
        .groupBy("payment_method")
        .agg(
            F.count("order_id").alias("total_orders"),
            money(F.sum("revenue")).alias("total_revenue"),
        )
        .orderBy(
            F.col("total_revenue").desc_nulls_first(), F.col("payment_method").asc_nulls_last()
        )
    )


# --- daily, last 30 days ----------------------------------------------------------

def vw_daily_sales_30d(df: DataFrame, as_of=None) -> DataFrame:
    """View: Completed orders and revenue per day since ``as_of`` date - 30 days.

    No upper bound, so orders dated after ``as_of`` are included.  The
    bound is a constant after folding and pushes into the scan.
    """
    start = F.date_sub(F.to_date(as_of_literal(as_of)), DAILY_WINDOW_DAYS).cast("timestamp_ntz")
    return (
        completed(df)
        .where(F.col("order_date") >= start)
        .groupBy(F.to_date("order_date").alias("sale_date"))
        .agg(
            F.count("order_id").alias("orders"),
            money(F.sum("revenue")).alias("daily_revenue"),
        )
        .orderBy(F.col("sale_date").asc_nulls_last())
    )


# --- pivot ---------------------------------------------------------------------------

def category_region_pivot(df: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Category x region matrix of Completed revenue; empty cells are 0.

    The rows are aggregated to (category, region) sums once; without
    ``regions`` that small aggregate is written to the shared folder and the
    pivot values are read from it, so the orders are scanned once and
    Spark's cap on discovered pivot values does not apply.  Column names
    have spaces replaced by ``_``; names that would clash get ``_2``, ``_3``...
    """
    cells = (
        _known(completed(df), "category", "region")
        .groupBy("category", "region")
        .agg(pandas_sum("revenue").alias("_sum"))
    )
    if not regions:
        cells = materialize(cells, "pivot_cells")
        regions = [r["region"] for r in cells.select("region").distinct().orderBy("region").collect()]
    names, used = [], {"category"}
    for region in regions:
        name = base = region.replace(" ", "_")
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        names.append(name)
    sums = [
        money(pandas_sum(F.when(F.col("region") == region, F.col("_sum")))).alias(name)
        for region, name in zip(regions, names)
    ]
    out = cells.groupBy("category")
    return (out.agg(*sums) if sums else out.agg(F.count(F.lit(1)).alias("_n")).drop("_n")).orderBy("category")


# --- top-k and preview -------------------------------------------------------------

TOP_COLUMNS = ["order_id", "order_date", "category", "region", "revenue", "quantity", "status"]


def top_completed(df: DataFrame, k: int = TOP_ORDERS_LIMIT) -> DataFrame:
    """The ``k`` Completed orders with the highest revenue (all columns).

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task
    keeps its own top ``k``, and only those reach the final merge.  Ties
    are broken by ``order_id`` and then every other column.
    """
    order = [F.col("revenue").desc_nulls_first()] + [
        F.col(c).asc_nulls_last() for c in ["order_id"] + [c for c in DEDUP_ORDER if c != "revenue"]
    ]
    return completed(df).orderBy(*order).limit(k)


def vw_top_orders(df: DataFrame, k: int = TOP_ORDERS_LIMIT) -> DataFrame:
    """View: the ``k`` Completed orders with the highest revenue."""
    return top_completed(df, k).select(*TOP_COLUMNS)


def preview_orders(df: DataFrame, n: int = PREVIEW_LIMIT) -> DataFrame:
    """First ``n`` rows by date (then all columns), with revenue as money text."""
    from kpiforge.functions.expressions import money_text

    order = [F.col(c).asc_nulls_last() for c in ["order_date", "order_id"] + DEDUP_ORDER[1:]]
    return (
        df.orderBy(*order)
        .limit(n)
        .withColumn("revenue_text", money_text(F.col("revenue"), 2))
    )


def preview_caption(df: DataFrame, n: int = PREVIEW_LIMIT) -> DataFrame:
    """``[shown, total_records, caption]``: "Showing first 500 of 12,345 records"."""
    from kpiforge.functions.expressions import count_text

    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        F.least(F.lit(n).cast("long"), F.col("total_records")).alias("shown"),
        "total_records",
        F.concat(
            F.lit(f"Showing first {n} of "), count_text(F.col("total_records")), F.lit(" records")
        ).alias("caption"),
    )


# --- period over period ------------------------------------------------------------

def previous_window(date_from, date_to) -> tuple[dt.date, dt.date]:
    """Same number of days as ``[from, to]``, ending the day before ``from``."""
    f, t = as_date(date_from), as_date(date_to)
    days = (t - f).days + 1
    prev_to = f - dt.timedelta(days=1)
    return prev_to - dt.timedelta(days=days - 1), prev_to


def _two_window_kpis(span: DataFrame, in_cur: Column, in_prev: Column) -> DataFrame:
    """The six KPIs of both windows as one row of DOUBLE columns ``c_*`` and ``p_*``.

    One aggregate per customer (partial before its shuffle) with sums and
    flags of both windows, then one over customers: the distinct counts are
    sums of flags, so no row is copied per distinct expression.
    """
    parts = {}
    for p, cond in (("c", in_cur), ("p", in_prev)):
        done = cond & is_completed()
        parts |= {
            f"{p}_rev": F.sum(F.when(done, F.col("revenue"))),
            f"{p}_priced": F.count(F.when(done, F.col("revenue"))),
            f"{p}_rows": F.count_if(cond),
            f"{p}_cancelled": F.count_if(cond & is_cancelled()),
            f"{p}_done": F.count_if(done),
        }
    by_customer = span.groupBy("customer_id").agg(*[c.alias(n) for n, c in parts.items()])
    known = F.col("customer_id").isNotNull()
    total = by_customer.agg(
        *[F.sum(n).alias(n) for n in parts],
        *[F.count_if(known & (F.col(f"{p}_rows") > 0)).alias(f"{p}_customers") for p in ("c", "p")],
    )
    out = []
    for p in ("c", "p"):
        rows = F.coalesce(f"{p}_rows", F.lit(0))
        kpis = {
            "total_revenue": money(F.coalesce(f"{p}_rev", F.lit(0))),
            "total_orders": rows,
            "avg_order_value": exact_ratio(F.col(f"{p}_rev"), F.col(f"{p}_priced"), 4),
            "cancellation_rate": pct(F.coalesce(f"{p}_cancelled", F.lit(0)), rows),
            "completed_orders": F.coalesce(f"{p}_done", F.lit(0)),
            "unique_customers": F.col(f"{p}_customers"),
        }
        out += [kpis[k].cast("double").alias(f"{p}_{k}") for k in KPI_ORDER]
    return total.select(*out)


def kpi_delta(df: DataFrame, date_from, date_to) -> DataFrame:
    """``[card_order, metric, current_value, previous_value, delta_pct]``.

    Both windows come from one scan restricted to ``[previous from, to]``
    (pushed into the scan when the input is a table), one aggregate per
    customer and one over customers.  ``delta_pct`` is ``(cur - prev) / prev * 100`` on the
    published values, NULL when ``prev`` is 0 or missing.
    """
    f, t = as_date(date_from), as_date(date_to)
    pf, _ = previous_window(f, t)
    end = ts_literal(t + dt.timedelta(days=1))
    in_cur = F.col("order_date") >= ts_literal(f)
    in_prev = F.col("order_date") < ts_literal(f)
    span = df.where((F.col("order_date") >= ts_literal(pf)) & (F.col("order_date") < end))
    return delta_rows(_two_window_kpis(span, in_cur, in_prev))


def delta_rows(one: DataFrame) -> DataFrame:
    """The rows of ``kpi_delta`` from the KPIs of both windows (``c_*`` and ``p_*``) in one row."""
    card_keys = [
        "total_revenue", "total_orders", "avg_order_value",
        "cancellation_rate", "unique_customers", "completed_orders",
    ]
    rows = []
    for i, k in enumerate(card_keys):
        c, p = F.col(f"c_{k}"), F.col(f"p_{k}")
        rows.append(
            [F.lit(i + 1), F.lit(KPI_LABELS[i]), c, p, F.when(p != 0, (c - p) / p * F.lit(100.0))]
        )
    return rows_of(
        one, rows, ["card_order", "metric", "current_value", "previous_value", "delta_pct"]
    )
