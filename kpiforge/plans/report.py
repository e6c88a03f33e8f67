"""Report tables: KPI cards, formatted category table, sheets of the bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.expressions import (
    avg_money,
    count_text,
    heading,
    money,
    money_text,
    pandas_sum,
    percent_text,
    stamp_text,
)
from kpiforge.operators import cleaning, metrics
from kpiforge.operators.stats import rows_of
from kpiforge.plans.tables import OrderTables
from kpiforge.schema import HEAD_CATEGORY_SCREEN, HEAD_QUALITY, KPI_LABELS, ORDER_COLUMNS


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """``[card_order, label, value_text]`` from a one-row ``kpi_summary``."""
    values = [
        money_text(F.col("total_revenue"), 0),
        count_text(F.col("total_orders")),
        money_text(F.col("avg_order_value"), 0),
        percent_text(F.col("cancellation_rate")),
        count_text(F.col("unique_customers")),
        count_text(F.col("completed_orders")),
    ]
    rows = [[F.lit(i + 1), F.lit(label), v] for i, (label, v) in enumerate(zip(KPI_LABELS, values))]
    return rows_of(kpis, rows, ["card_order", "label", "value_text"])


def category_table_formatted(df: DataFrame) -> DataFrame:
    """Dashboard category table: orders, ``₹`` revenue and AOV text, units."""
    h = HEAD_CATEGORY_SCREEN
    g = (
        metrics.completed(df)
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.count("order_id").alias(h[1]),
            pandas_sum("revenue").alias("_rev"),
            avg_money("revenue").alias("_aov"),
            pandas_sum("quantity").alias(h[4]),
        )
    )
    return g.orderBy(F.col("_rev").desc(), "category").select(
        F.col("category").alias(h[0]),
        h[1],
        money_text(money("_rev"), 0).alias(h[2]),
        money_text(F.col("_aov"), 0).alias(h[3]),
        h[4],
    )


def report_raw_data(df: DataFrame) -> DataFrame:
    """All filtered clean rows, nine columns, with display headings."""
    return df.select(*[F.col(c).alias(heading(c)) for c in ORDER_COLUMNS])


def report_quality(issues: DataFrame, as_of=None) -> DataFrame:
    """Quality sheet: issue type, count, action, severity, last-refreshed stamp."""
    return cleaning.issue_severity(issues).select(
        "step",
        F.col("issue_type").alias(HEAD_QUALITY[0]),
        F.col("issue_count").alias(HEAD_QUALITY[1]),
        F.col("action").alias(HEAD_QUALITY[2]),
        "severity",
        stamp_text(as_of).alias("last_refreshed"),
    )


def report_tables(t: OrderTables) -> dict[str, DataFrame]:
    """The six tables of the report bundle.

    Scope as in the reference: filtered rows and filtered KPIs, issues of
    the unfiltered cleaning run.
    """
    filtered = t.filtered
    return {
        "kpi_cards": kpi_cards(metrics.kpi_summary(filtered)),
        "category": metrics.report_category(filtered),
        "revenue_trend": metrics.report_revenue_trend(filtered),
        "regional": metrics.report_regional(filtered),
        "data_quality": report_quality(t.issues, t.as_of),
        "raw_data": report_raw_data(filtered),
    }
