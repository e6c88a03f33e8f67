"""

Every query reads the star-schema test tables of ``sf_dir``, conforms
them into raw ``orders`` and runs the engine on the whole table.  The
oracle SQL computes the same result in DuckDB from the same tables.
Money columns are published as ``CAST(ROUND(x, 2) AS DOUBLE)`` on both
sides; averages and percents are rounded half-up with exact arithmetic.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.operators import cleaning, filters, metrics
from kpiforge.plans import cells, pages, prefix, report, views
from kpiforge.plans.rollup import order_rollup
from kpiforge.plans.tables import FilterSpec, OrderTables
from kpiforge.session import ensure_checkpoint_dir, scratch_path
from kpiforge.sinks.files import export_csv, read_exported_orders, write_bundle
from kpiforge.sources import bucketed, footers, splits
from kpiforge.sources.orders import conform_test_tables
from kpiforge.sources.quarantine import judged, read_texts
from kpiforge.streaming.incremental import refresh_incremental_once
from kpiforge.streaming.refresh import refresh_once

# Queries of the optional subpackage and of the corpus pipeline: there only if both can be
# imported, with all packages that they need.
try:
    import corpus_pipeline
    from kpiforge.llm.registry import ORACLES as EXTRA_ORACLES
    from kpiforge.llm.registry import QUERIES as EXTRA_QUERIES

    EXTRA_QUERIES = EXTRA_QUERIES | {"pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        EXTRA_ORACLES = EXTRA_ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
except ImportError as missing:
    if missing.name not in ("corpus_pipeline", "kpiforge.llm", "kpiforge.llm.registry"):
        warnings.warn(f"the queries of kpiforge.llm and the pipeline are left out: {missing}", stacklevel=1)
    EXTRA_QUERIES, EXTRA_ORACLES = {}, {}

SF_SMOKE = "/root/testdata/sf0.001"

# Parameters of the registered queries (fixed so results are repeatable).
AS_OF = "2001-06-15 00:00:00"
REPORT_FILTER = FilterSpec(
    date_from="1996-01-01",
    date_to="1997-06-30",
    categories=["PROMO", "SMALL"],
    regions=["All"],
    statuses=["Completed", "Cancelled", "Refunded"],
)
NOOP_FILTER = FilterSpec(categories=["All"], regions=[], statuses=["All", "Completed"])
SPLIT_PARTS, PAGE = 7, 3
DELTA_FROM, DELTA_TO = "2000-07-01", "2000-09-30"


def _tables(spark: SparkSession, sf_dir: str, materialized: bool = False) -> OrderTables:
    """The orders of the star-schema tables; ``materialized`` for queries that read the clean ones more than once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return OrderTables(conform_test_tables(spark, sf_dir), as_of=AS_OF, filters=REPORT_FILTER, materialized=materialized)


def _public(df: DataFrame) -> DataFrame:
    """Row-level outputs publish DECIMAL money as DOUBLE."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = export_csv(_tables(spark, sf_dir, materialized=True).clean, scratch_path(spark, "export_csv"))
    return _public(read_exported_orders(spark, path))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: category performance view over cleaned sf0.001 orders."""
    return metrics.vw_category_performance(_tables(spark, SF_SMOKE).clean)


def _q(fn: Callable[[OrderTables], DataFrame], materialized: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_tables(spark, sf_dir, materialized))


def _view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return _q(lambda t: views.build_views(t.raw, t.clean, AS_OF)[name])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and cleaning
        "raw_orders": _q(lambda t: _public(t.raw)),
        "category_median": _q(lambda t: _public(t.medians)),
        "fill_missing_median": _q(lambda t: _public(t.filled)),
        "dedup_orders": _q(lambda t: _public(t.deduped)),
        "drop_negative": _q(lambda t: _public(cleaning.drop_negative(t.raw))),
        "clean_orders": _q(lambda t: _public(t.clean)),
        "issue_log": _q(lambda t: t.issues),
        "issue_severity": _q(lambda t: cleaning.issue_severity(t.issues)),
        "null_profile": _q(lambda t: cleaning.null_profile(t.raw)),
        "null_profile_nonzero": _q(lambda t: cleaning.null_profile_nonzero(t.raw)),
        "record_funnel": _q(lambda t: t.funnel),
        # filters
        "filter_orders": _q(lambda t: _public(t.filtered)),
        "filter_noop": _q(lambda t: _public(NOOP_FILTER.apply(t.clean))),
        "date_bounds": _q(lambda t: filters.date_bounds(t.clean)),
        "filter_domains": _q(lambda t: filters.filter_domains(t.clean)),
        # KPIs and dashboard aggregates
        "kpi_summary": _q(lambda t: metrics.kpi_summary(t.clean)),
        "kpi_filtered": _q(lambda t: metrics.kpi_summary(t.filtered)),
        "kpi_delta": _q(lambda t: metrics.kpi_delta(t.clean, DELTA_FROM, DELTA_TO)),
        "revenue_by_month": _q(lambda t: metrics.revenue_by_month(t.clean)),
        "revenue_by_category": _q(lambda t: metrics.revenue_by_category(t.clean)),
        "aov_by_category": _q(lambda t: metrics.aov_by_category(t.clean)),
        "orders_by_region": _q(lambda t: metrics.orders_by_region(t.clean)),
        "region_revenue_share": _q(lambda t: metrics.region_revenue_share(t.clean)),
        "status_distribution": _q(lambda t: metrics.status_distribution(t.clean)),
        "revenue_by_payment": _q(lambda t: metrics.revenue_by_payment(t.clean)),
        "category_region_pivot": _q(lambda t: metrics.category_region_pivot(t.clean)),
        "preview_orders": _q(lambda t: _public(metrics.preview_orders(t.clean))),
        "preview_caption": _q(lambda t: metrics.preview_caption(t.filtered)),
        # the eight SQL views
        "vw_revenue_trend": _view("vw_revenue_trend"),
        "vw_category_performance": _view("vw_category_performance"),
        "vw_regional_sales": _view("vw_regional_sales"),
        "vw_order_status": _view("vw_order_status"),
        "vw_payment_methods": _view("vw_payment_methods"),
        "vw_data_quality": _view("vw_data_quality"),
        "vw_top_orders": _q(lambda t: _public(views.build_views(t.raw, t.clean, AS_OF)["vw_top_orders"])),
        "vw_daily_sales_30d": _view("vw_daily_sales_30d"),
        # report tables
        "kpi_cards": _q(lambda t: report.kpi_cards(metrics.kpi_summary(t.filtered))),
        "category_table_formatted": _q(lambda t: report.category_table_formatted(t.clean)),
        "report_category": _q(lambda t: metrics.report_category(t.filtered)),
        "report_revenue_trend": _q(lambda t: metrics.report_revenue_trend(t.filtered)),
        "report_regional": _q(lambda t: metrics.report_regional(t.filtered)),
        "report_raw_data": _q(lambda t: _public(report.report_raw_data(t.filtered))),
        "export_csv_roundtrip": _csv_roundtrip,
        # orders as text lines, some of them broken: parsed, or refused with a reason
        "quarantine_orders": _quarantine,
        # filtered KPIs from cells with customer bitmaps, without the orders
        "cells_kpi_filtered": _q(lambda t: cells.kpi_summary_from_cells(cells.build_cells(t.clean), REPORT_FILTER), materialized=True),
        "cells_report_regional": _q(lambda t: cells.report_regional_from_cells(cells.build_cells(t.clean), REPORT_FILTER), materialized=True),
        # any window as a difference of two prefix rows; a page of the preview beyond the first
        "prefix_kpi_delta": _q(_prefix_delta, materialized=True),
        "prefix_daily_sales_30d": _q(lambda t: prefix.daily_sales_from_prefix(prefix.build_prefix(order_rollup(t.clean)), AS_OF)),
        "page_orders": _q(lambda t: _public(pages.write_pages(t.clean, parts=8).page(PAGE)), materialized=True),
        # layouts: a table bucketed by id, split bounds of equal depth, answers from file footers
        "bucketed_dedup_orders": _bucketed_dedup,
        "split_predicate_rows": _split_rows,
        "footer_bounds": _footer_bounds,
        # refresh job (Structured Streaming, availableNow) over the raw orders
        "refresh_category_performance": lambda spark, sf_dir: refresh_once(
            spark, _tables(spark, sf_dir).raw, as_of=AS_OF
        ),
        # incremental refresh: all raw rows arrive in several files, as they come
        "incremental_regional_sales": _incremental("vw_regional_sales"),
        "incremental_data_quality": _incremental("vw_data_quality"),
        "incremental_issue_log": _incremental("issue_log"),
        "incremental_category_median": _incremental("category_median"),
        "incremental_top_orders": _incremental("vw_top_orders"),
        # the dashboard's tables on the filtered rows
        **{f"dashboard_{k}": _q(lambda t, fn=fn: fn(t.filtered)) for k, fn in _DASHBOARD.items()},
        "dashboard_top_orders": _q(lambda t: _public(_with_position(metrics.vw_top_orders(t.filtered)))),
        # SQL over the registered views, and a report sheet read back from the written bundle
        "sql_over_views": _sql_over_views,
        "bundle_category_sheet": _bundle_sheet("category"),
        "bundle_kpi_cards": _bundle_sheet("kpi_cards"),
        "bundle_raw_data": _bundle_sheet("raw_data"),
        **EXTRA_QUERIES,
    }


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw orders as CSV lines, those of some quantities broken in one way or another, read back."""
    ensure_checkpoint_dir(spark)
    quantity, text = F.col("quantity"), {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _COLS}
    text["order_date"] = F.when(quantity.isin(11, 19), F.lit("n/a")).otherwise(F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
    text["revenue"] = F.when(quantity.isin(13, 19), F.lit("12.3.4")).when(quantity == 23, F.lit("1.005")).otherwise(text["revenue"])
    text["quantity"] = F.when(quantity == 7, F.lit("seven")).otherwise(text["quantity"])
    line = F.when(quantity == 17, F.concat_ws(",", *[text[c] for c in _COLS[:4]])).otherwise(F.concat_ws(",", *[text[c] for c in _COLS]))
    path = scratch_path(spark, "order_lines")
    _tables(spark, sf_dir).raw.select(line.alias("value")).write.text(path)
    return _public(judged(read_texts(spark, path)))


def _prefix_delta(t: OrderTables) -> DataFrame:
    built = cells.build_cells(t.clean)
    return prefix.kpi_delta_from_prefix(prefix.build_prefix(built.rollup), built, DELTA_FROM, DELTA_TO)


def _bucketed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    stored = bucketed.scratch_table(t.raw, "orders_by_id", bucketed.table_buckets(spark))
    return _public(cleaning.dedup_orders(cleaning.fill_missing_median(stored, t.medians)))


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _tables(spark, sf_dir).raw
    return splits.rows_by_predicate(raw, splits.split_predicates(splits.equal_depth_parts(raw, SPLIT_PARTS)))


def _footer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "orders_with_day")
    footers.write_with_day(_tables(spark, sf_dir).clean, path)
    return footers.table_bounds(spark, path)


def _incremental(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _public(refresh_incremental_once(spark, [_tables(spark, sf_dir).raw], as_of=AS_OF)[name])

    return run


_DASHBOARD: dict[str, Callable[[DataFrame], DataFrame]] = {
    "revenue_by_month": metrics.revenue_by_month,
    "revenue_by_category": metrics.revenue_by_category,
    "aov_by_category": metrics.aov_by_category,
    "orders_by_region": metrics.orders_by_region,
    "status_distribution": metrics.status_distribution,
    "revenue_by_payment": metrics.revenue_by_payment,
    "category_region_pivot": metrics.category_region_pivot,
    "category_table_formatted": report.category_table_formatted,
    "preview_orders": lambda df: _public(metrics.preview_orders(df)),
    "preview_caption": metrics.preview_caption,
}


def _with_position(top: DataFrame) -> DataFrame:
    """The ten rows with their position, so their order is part of the result."""
    order = [F.col("revenue").desc_nulls_first(), F.col("order_id").asc_nulls_last()]
    return top.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order)))


def _sql_over_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    views.register_views(t.raw, t.clean, AS_OF)
    return spark.sql(
        "SELECT region, total_orders, total_revenue, (SELECT COUNT(*) FROM vw_category_performance) AS categories "
        "FROM vw_regional_sales WHERE total_orders > 0"
    )


def _bundle_sheet(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        sheet = report.report_tables(_tables(spark, sf_dir))[name]
        paths = write_bundle({name: sheet}, scratch_path(spark, "bundle"), "20010615_0000")
        return _public(spark.read.parquet(paths[name]))

    return run


# --------------------------------------------------------------------------------------
# DuckDB oracle
# --------------------------------------------------------------------------------------

_COLS = [
    "order_id", "order_date", "category", "region", "payment_method",
    "status", "revenue", "quantity", "customer_id",
]
_PUB = ", ".join("CAST(revenue AS DOUBLE) AS revenue" if c == "revenue" else c for c in _COLS)
_ORDER_ALL = ", ".join(f"{c} ASC NULLS LAST" for c in _COLS[1:])
_TS_AS_OF = f"TIMESTAMP '{AS_OF}'"


def _money(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DOUBLE)"


def _psum(expr: str) -> str:
    return f"COALESCE(SUM({expr}), 0)"


def _avg(expr: str) -> str:
    """Exact half-up average of a DECIMAL(18,4) to cents, as DOUBLE."""
    s = f"CAST(SUM({expr}) * 10000 AS HUGEINT)"
    n = f"COUNT({expr})"
    return (
        f"(CASE WHEN {n} = 0 THEN NULL "
        f"WHEN {s} >= 0 THEN CAST((2 * {s} + 100 * {n}) // (200 * {n}) AS DOUBLE) / 100 "
        f"ELSE -CAST((2 * (-{s}) + 100 * {n}) // (200 * {n}) AS DOUBLE) / 100 END)"
    )


def _pct(part: str, whole: str) -> str:
    """Exact half-up ``100 * part / whole`` to 2 decimals (non-negative counts)."""
    p, w = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    return (
        f"(CASE WHEN {w} = 0 THEN NULL "
        f"ELSE CAST((20000 * {p} + {w}) // (2 * {w}) AS DOUBLE) / 100 END)"
    )


_STATUS = (
    "CASE WHEN l.l_linestatus = 'F' THEN 'Completed' WHEN l.l_returnflag = 'A' THEN 'Pending' "
    "WHEN l.l_returnflag = 'N' THEN 'Cancelled' ELSE 'Refunded' END"
)
_PRICE = "CAST(l.l_extendedprice AS DECIMAL(18,2))"

_BASE = f"""
WITH raw AS (
  SELECT concat('ORD-', CAST(l.l_orderkey AS VARCHAR), '-', CAST(l.l_linenumber AS VARCHAR)) AS order_id,
         o.o_orderdate AS order_date,
         p.p_type AS category,
         r.r_name AS region,
         o.o_orderpriority AS payment_method,
         {_STATUS} AS status,
         CASE WHEN l.l_partkey % 67 = 0 THEN NULL
              WHEN l.l_partkey % 211 = 0 THEN -{_PRICE}
              ELSE {_PRICE} END AS revenue,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         concat('CUST-', CAST(o.o_custkey AS VARCHAR)) AS customer_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
med AS (
  SELECT category, CAST(MEDIAN(CAST(revenue AS DOUBLE)) AS DECIMAL(18,4)) AS median_revenue
  FROM raw GROUP BY category
),
filled AS (
  SELECT r.order_id, r.order_date, r.category, r.region, r.payment_method, r.status,
         COALESCE(CAST(r.revenue AS DECIMAL(18,4)), m.median_revenue) AS revenue,
         r.quantity, r.customer_id
  FROM raw r LEFT JOIN med m ON r.category = m.category
),
deduped AS (
  SELECT {", ".join(_COLS)} FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY {_ORDER_ALL}) AS rn FROM filled
  ) WHERE rn = 1
),
clean AS (SELECT * FROM deduped WHERE revenue IS NULL OR revenue >= 0),
filtered AS (
  SELECT * FROM clean
  WHERE order_date >= TIMESTAMP '1996-01-01 00:00:00' AND order_date < TIMESTAMP '1997-07-01 00:00:00'
    AND category IN ('PROMO', 'SMALL')
    AND status IN ('Completed', 'Cancelled', 'Refunded')
)
"""

_COMPLETED = "status = 'Completed'"


def _kpis(src: str, cond: str = "TRUE", prefix: str = "") -> str:
    comp = f"CASE WHEN {cond} AND {_COMPLETED} THEN revenue END"
    rows = f"COUNT(*) FILTER (WHERE {cond})"
    return f"""
  {_money(f"COALESCE(SUM({comp}), 0)")} AS {prefix}total_revenue,
  {rows} AS {prefix}total_orders,
  {_avg(comp)} AS {prefix}avg_order_value,
  {_pct(f"COUNT(*) FILTER (WHERE {cond} AND status = 'Cancelled')", rows)} AS {prefix}cancellation_rate,
  COUNT(*) FILTER (WHERE {cond} AND {_COMPLETED}) AS {prefix}completed_orders,
  COUNT(DISTINCT CASE WHEN {cond} THEN customer_id END) AS {prefix}unique_customers"""


def _kpi_select(src: str) -> str:
    return f"SELECT {_kpis(src)} FROM {src}"


def _kpi_delta_sql() -> str:
    cur, prev = "order_date >= TIMESTAMP '2000-07-01 00:00:00'", "order_date < TIMESTAMP '2000-07-01 00:00:00'"
    span = (
        "SELECT * FROM clean WHERE order_date >= TIMESTAMP '2000-03-31 00:00:00' "
        "AND order_date < TIMESTAMP '2000-10-01 00:00:00'"
    )
    cards = [
        ("Total Revenue", "total_revenue"),
        ("Total Orders", "total_orders"),
        ("Avg Order Value", "avg_order_value"),
        ("Cancellation Rate", "cancellation_rate"),
        ("Unique Customers", "unique_customers"),
        ("Completed Orders", "completed_orders"),
    ]
    parts = []
    for i, (label, k) in enumerate(cards, 1):
        c, p = f"CAST(c_{k} AS DOUBLE)", f"CAST(p_{k} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS card_order, '{label}' AS metric, {c} AS current_value, "
            f"{p} AS previous_value, CASE WHEN {p} <> 0 THEN ({c} - {p}) / {p} * 100.0::DOUBLE END AS delta_pct FROM k"
        )
    return (
        _BASE
        + f", span AS ({span}), k AS (SELECT {_kpis('span', cur, 'c_')}, {_kpis('span', prev, 'p_')} FROM span)\n"
        + "\nUNION ALL\n".join(parts)
    )


def _issue_rows() -> str:
    return f"""
SELECT * FROM (
  SELECT 1 AS step, 'Missing Values' AS issue_type,
         (SELECT COUNT(*) FROM raw WHERE revenue IS NULL) AS issue_count,
         'Filled with category median' AS action
  UNION ALL SELECT 2, 'Duplicate Order IDs',
         (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM deduped), 'Removed duplicates'
  UNION ALL SELECT 3, 'Negative Revenue', (SELECT COUNT(*) FROM deduped WHERE revenue < 0), 'Removed rows'
  UNION ALL SELECT 4, 'Future Dates', (SELECT COUNT(*) FROM clean WHERE order_date > {_TS_AS_OF}), 'Flagged'
  UNION ALL SELECT 5, 'Records After Cleaning', (SELECT COUNT(*) FROM clean),
         'Started with ' || CAST((SELECT COUNT(*) FROM raw) AS VARCHAR)
) WHERE issue_count > 0 OR issue_type = 'Records After Cleaning'"""


def _null_profile(nonzero: bool) -> str:
    counts = ", ".join(f"COUNT(*) - COUNT({c}) AS m{i}" for i, c in enumerate(_COLS, 1))
    rows = "\nUNION ALL\n".join(
        f"SELECT {i} AS column_position, '{c}' AS column_name, m{i} AS missing_count, "
        f"{_pct(f'm{i}', 'total')} AS missing_pct FROM np"
        for i, c in enumerate(_COLS, 1)
    )
    where = " WHERE missing_count > 0" if nonzero else ""
    return _BASE + f", np AS (SELECT COUNT(*) AS total, {counts} FROM raw)\nSELECT * FROM ({rows}){where}"


def _pivot() -> str:
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    cols = ", ".join(
        f"{_money(_psum(f'CASE WHEN region = {chr(39)}{r}{chr(39)} THEN revenue END'))} AS {r.replace(' ', '_')}"
        for r in regions
    )
    return (
        _BASE
        + f"SELECT category, {cols} FROM clean WHERE {_COMPLETED} AND category IS NOT NULL "
        "AND region IS NOT NULL GROUP BY category"
    )


def _kpi_cards() -> str:
    k = f"k AS ({_kpi_select('filtered')})"
    return (
        _BASE
        + f", {k}\n"
        + "SELECT 1 AS card_order, 'Total Revenue' AS label, '₹' || format('{:,.0f}', total_revenue) AS value_text FROM k\n"
        + "UNION ALL SELECT 2, 'Total Orders', format('{:,}', total_orders) FROM k\n"
        + "UNION ALL SELECT 3, 'Avg Order Value', '₹' || format('{:,.0f}', avg_order_value) FROM k\n"
        + "UNION ALL SELECT 4, 'Cancellation Rate', CAST(cancellation_rate AS VARCHAR) || '%' FROM k\n"
        + "UNION ALL SELECT 5, 'Unique Customers', format('{:,}', unique_customers) FROM k\n"
        + "UNION ALL SELECT 6, 'Completed Orders', format('{:,}', completed_orders) FROM k"
    )


def _quarantine_sql() -> str:
    text = {c: f"COALESCE(CAST({c} AS VARCHAR), '')" for c in _COLS}
    text["order_date"] = "CASE WHEN quantity IN (11, 19) THEN 'n/a' ELSE strftime(order_date, '%Y-%m-%d %H:%M:%S') END"
    text["revenue"] = f"CASE WHEN quantity IN (13, 19) THEN '12.3.4' WHEN quantity = 23 THEN '1.005' ELSE {text['revenue']} END"
    text["quantity"] = f"CASE WHEN quantity = 7 THEN 'seven' ELSE {text['quantity']} END"
    line = lambda cols: " || ',' || ".join(text[c] for c in cols)
    bad = {"order_date": "11, 19", "revenue": "13, 19", "quantity": "7"}
    values = ", ".join(
        f"CASE WHEN quantity = 17{f' OR quantity IN ({bad[c]})' if c in bad else ''} THEN NULL "
        f"ELSE {'CAST(CASE WHEN quantity = 23 THEN 1.01 ELSE revenue END AS DOUBLE)' if c == 'revenue' else c} END AS {c}"
        if c not in _COLS[:4] or c == "order_date"
        else c
        for c in _COLS
    )
    values = values.replace("CASE WHEN quantity = 17 OR quantity IN (11, 19)", "CASE WHEN quantity IN (11, 19)")
    return (
        _BASE
        + f"""SELECT {values},
  CASE quantity WHEN 17 THEN 'record: malformed' WHEN 11 THEN 'order_date: not a date' WHEN 13 THEN 'revenue: not a number'
    WHEN 19 THEN 'order_date: not a date; revenue: not a number' WHEN 23 THEN 'revenue: more than 2 decimals'
    WHEN 7 THEN 'quantity: not an integer' END AS reason,
  CASE WHEN quantity = 17 THEN {line(_COLS[:4])} ELSE {line(_COLS)} END AS record
FROM raw"""
    )


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each key of ``queries()`` (same tables, same parameters)."""
    b = _BASE
    pub_clean = f"SELECT {_PUB} FROM clean"
    heading = ", ".join(
        f'CAST(revenue AS DOUBLE) AS "Revenue"' if c == "revenue" else f'{c} AS "{c.replace("_", " ").title()}"'
        for c in _COLS
    )
    top_cols = ", ".join(f"{c} ASC NULLS LAST" for c in _COLS[1:] if c != "revenue")
    sev = "CASE WHEN issue_count > 0 AND issue_type NOT LIKE '%Records%' THEN 'warn' ELSE 'ok' END"
    out = {
        "raw_orders": b + f"SELECT {_PUB} FROM raw",
        "category_median": b + "SELECT category, CAST(median_revenue AS DOUBLE) AS median_revenue FROM med",
        "fill_missing_median": b + f"SELECT {_PUB} FROM filled",
        "dedup_orders": b + f"SELECT {_PUB} FROM deduped",
        "drop_negative": b + f"SELECT {_PUB} FROM raw WHERE revenue IS NULL OR revenue >= 0",
        "clean_orders": b + pub_clean,
        "issue_log": b + _issue_rows(),
        "issue_severity": b + f"SELECT *, {sev} AS severity FROM ({_issue_rows()})",
        "null_profile": _null_profile(False),
        "null_profile_nonzero": _null_profile(True),
        "record_funnel": b
        + """SELECT 1 AS stage_order, 'Raw Data' AS stage, (SELECT COUNT(*) FROM raw) AS records
UNION ALL SELECT 2, 'After Dedup', (SELECT COUNT(*) FROM deduped)
UNION ALL SELECT 3, 'After Null Fill', (SELECT COUNT(*) FROM clean)
UNION ALL SELECT 4, 'Final Clean', (SELECT COUNT(*) FROM filtered)""",
        "filter_orders": b + f"SELECT {_PUB} FROM filtered",
        "filter_noop": b + pub_clean,
        "date_bounds": b
        + "SELECT CAST(MIN(order_date) AS DATE) AS min_date, CAST(MAX(order_date) AS DATE) AS max_date FROM clean",
        "filter_domains": b
        + """SELECT column_name, 1 AS position, 'All' AS value
FROM (VALUES ('category'), ('region'), ('status')) t(column_name)
UNION ALL
SELECT column_name, CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY value) + 1 AS INTEGER) AS position, value
FROM (SELECT DISTINCT 'category' AS column_name, category AS value FROM clean WHERE category IS NOT NULL
      UNION ALL SELECT DISTINCT 'region', region FROM clean WHERE region IS NOT NULL
      UNION ALL SELECT DISTINCT 'status', status FROM clean WHERE status IS NOT NULL)""",
        "kpi_summary": b + _kpi_select("clean"),
        "kpi_filtered": b + _kpi_select("filtered"),
        "kpi_delta": _kpi_delta_sql(),
        "revenue_by_month": b
        + f"SELECT strftime(order_date, '%Y-%m') AS month, {_money(_psum('revenue'))} AS total_revenue "
        f"FROM clean WHERE {_COMPLETED} AND order_date IS NOT NULL GROUP BY 1",
        "revenue_by_category": b
        + f"SELECT category, {_money(_psum('revenue'))} AS revenue FROM clean "
        f"WHERE {_COMPLETED} AND category IS NOT NULL GROUP BY category",
        "aov_by_category": b
        + f"SELECT category, {_avg('revenue')} AS avg_order_value FROM clean "
        f"WHERE {_COMPLETED} AND category IS NOT NULL GROUP BY category",
        "orders_by_region": b
        + f"SELECT region, COUNT(order_id) AS total_orders, {_money(_psum('revenue'))} AS total_revenue "
        "FROM clean WHERE region IS NOT NULL GROUP BY region",
        "region_revenue_share": b
        + f"""SELECT region, {_money('s')} AS total_revenue,
  CASE WHEN tot = 0 THEN NULL ELSE CAST((20000 * CAST(s * 10000 AS HUGEINT) + CAST(tot * 10000 AS HUGEINT))
       // (2 * CAST(tot * 10000 AS HUGEINT)) AS DOUBLE) / 100 END AS revenue_share_pct
FROM (SELECT region, s, SUM(s) OVER () AS tot
      FROM (SELECT region, {_psum('revenue')} AS s FROM clean WHERE region IS NOT NULL GROUP BY region))""",
        "status_distribution": b
        + "SELECT status, COUNT(*) AS orders FROM clean WHERE status IS NOT NULL GROUP BY status",
        "revenue_by_payment": b
        + f"SELECT payment_method, {_money(_psum('revenue'))} AS revenue FROM clean "
        f"WHERE {_COMPLETED} AND payment_method IS NOT NULL GROUP BY payment_method",
        "category_region_pivot": _pivot(),
        "preview_orders": b
        + f"SELECT {_PUB}, '₹' || format('{{:,.2f}}', CAST(revenue AS DOUBLE)) AS revenue_text FROM clean "
        f"ORDER BY order_date ASC NULLS LAST, order_id ASC NULLS LAST, "
        + ", ".join(f"{c} ASC NULLS LAST" for c in _COLS[2:])
        + " LIMIT 500",
        "preview_caption": b
        + "SELECT LEAST(CAST(500 AS BIGINT), COUNT(*)) AS shown, COUNT(*) AS total_records, "
        "'Showing first 500 of ' || format('{:,}', COUNT(*)) || ' records' AS caption FROM filtered",
        "vw_revenue_trend": b
        + f"SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, {_money('SUM(revenue)')} AS total_revenue, "
        f"COUNT(order_id) AS total_orders, {_avg('revenue')} AS avg_order_value "
        f"FROM clean WHERE {_COMPLETED} GROUP BY 1",
        "vw_category_performance": b
        + f"SELECT category, COUNT(order_id) AS total_orders, {_money('SUM(revenue)')} AS total_revenue, "
        f"{_avg('revenue')} AS avg_order_value, CAST(SUM(quantity) AS BIGINT) AS total_units_sold "
        f"FROM clean WHERE {_COMPLETED} GROUP BY category",
        "vw_regional_sales": b
        + f"SELECT region, COUNT(order_id) AS total_orders, {_money('SUM(revenue)')} AS total_revenue, "
        f"{_avg('revenue')} AS avg_order_value, COUNT(DISTINCT customer_id) AS unique_customers "
        "FROM clean GROUP BY region",
        "vw_order_status": b
        + f"SELECT status, COUNT(order_id) AS order_count, "
        f"{_pct('COUNT(order_id)', 'SUM(COUNT(order_id)) OVER ()')} AS pct_share FROM clean GROUP BY status",
        "vw_payment_methods": b
        + f"SELECT payment_method, COUNT(order_id) AS total_orders, {_money('SUM(revenue)')} AS total_revenue "
        f"FROM clean WHERE {_COMPLETED} GROUP BY payment_method",
        "vw_data_quality": b
        + f"""SELECT 'Missing Revenue' AS issue_type, COUNT(*) FILTER (WHERE revenue IS NULL) AS issue_count, {_TS_AS_OF} AS checked_at FROM raw
UNION ALL SELECT 'Duplicate Order IDs', COUNT(*) - COUNT(DISTINCT order_id), {_TS_AS_OF} FROM raw
UNION ALL SELECT 'Future Dates', COUNT(*) FILTER (WHERE order_date > CAST(CAST({_TS_AS_OF} AS DATE) AS TIMESTAMP)), {_TS_AS_OF} FROM raw
UNION ALL SELECT 'Negative Revenue', COUNT(*) FILTER (WHERE revenue < 0), {_TS_AS_OF} FROM raw""",
        "vw_top_orders": b
        + "SELECT order_id, order_date, category, region, CAST(revenue AS DOUBLE) AS revenue, quantity, status "
        f"FROM clean WHERE {_COMPLETED} ORDER BY revenue DESC NULLS FIRST, order_id ASC NULLS LAST, "
        + ", ".join(f"{c} ASC NULLS LAST" for c in _COLS[1:] if c != "revenue")
        + " LIMIT 10",
        "vw_daily_sales_30d": b
        + f"SELECT CAST(order_date AS DATE) AS sale_date, COUNT(order_id) AS orders, "
        f"{_money('SUM(revenue)')} AS daily_revenue FROM clean "
        f"WHERE {_COMPLETED} AND order_date >= CAST(CAST({_TS_AS_OF} AS DATE) - INTERVAL 30 DAY AS TIMESTAMP) "
        "GROUP BY 1",
        "kpi_cards": _kpi_cards(),
        "category_table_formatted": b
        + f"""SELECT category, COUNT(order_id) AS "Orders",
  '₹' || format('{{:,.0f}}', {_money(_psum('revenue'))}) AS "Revenue",
  '₹' || format('{{:,.0f}}', {_avg('revenue')}) AS "AOV",
  CAST({_psum('quantity')} AS BIGINT) AS "Units"
FROM clean WHERE {_COMPLETED} AND category IS NOT NULL GROUP BY category""",
        "report_category": b
        + f"""SELECT category AS "Category", COUNT(order_id) AS "Total Orders",
  {_money(_psum('revenue'))} AS "Total Revenue (₹)", {_avg('revenue')} AS "Avg Order Value (₹)",
  CAST({_psum('quantity')} AS BIGINT) AS "Units Sold"
FROM filtered WHERE {_COMPLETED} AND category IS NOT NULL GROUP BY category""",
        "report_revenue_trend": b
        + f"""SELECT strftime(order_date, '%Y-%m') AS "Month", {_money(_psum('revenue'))} AS "Total Revenue (₹)",
  COUNT(order_id) AS "Total Orders"
FROM filtered WHERE {_COMPLETED} AND order_date IS NOT NULL GROUP BY 1""",
        "report_regional": b
        + f"""SELECT region AS "Region", COUNT(order_id) AS "Total Orders",
  {_money(_psum('revenue'))} AS "Total Revenue (₹)", COUNT(DISTINCT customer_id) AS "Unique Customers"
FROM filtered WHERE region IS NOT NULL GROUP BY region""",
        "report_raw_data": b + f"SELECT {heading} FROM filtered",
        "export_csv_roundtrip": b + pub_clean,
        "refresh_category_performance": b
        + f"SELECT category, COUNT(order_id) AS total_orders, {_money('SUM(revenue)')} AS total_revenue, "
        f"{_avg('revenue')} AS avg_order_value, CAST(SUM(quantity) AS BIGINT) AS total_units_sold "
        f"FROM clean WHERE {_COMPLETED} GROUP BY category",
        "dashboard_top_orders": b
        + f"SELECT order_id, order_date, category, region, CAST(revenue AS DOUBLE) AS revenue, quantity, status, "
        f"CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC NULLS FIRST, order_id ASC NULLS LAST, {top_cols}) AS INTEGER) AS position "
        f"FROM filtered WHERE {_COMPLETED} ORDER BY position LIMIT 10",
        "sql_over_views": b
        + f"SELECT region, COUNT(order_id) AS total_orders, {_money('SUM(revenue)')} AS total_revenue, "
        f"(SELECT COUNT(DISTINCT category) FROM clean WHERE {_COMPLETED}) AS categories "
        "FROM clean GROUP BY region HAVING COUNT(order_id) > 0",
    }
    out["cells_kpi_filtered"] = out["kpi_filtered"]
    out["cells_report_regional"] = out["report_regional"]
    out["quarantine_orders"] = _quarantine_sql()
    out["prefix_kpi_delta"] = out["kpi_delta"]
    out["prefix_daily_sales_30d"] = out["vw_daily_sales_30d"]
    out["page_orders"] = (
        b
        + f"SELECT {_PUB}, ROW_NUMBER() OVER (ORDER BY order_date ASC NULLS LAST, order_id ASC NULLS LAST, "
        + ", ".join(f"{c} ASC NULLS LAST" for c in _COLS[2:])
        + f") AS position FROM clean QUALIFY position > {PAGE * 500} AND position <= {(PAGE + 1) * 500}"
    )
    out["bucketed_dedup_orders"] = out["dedup_orders"]
    out["footer_bounds"] = b + "SELECT CAST(MIN(order_date) AS DATE) AS min_date, CAST(MAX(order_date) AS DATE) AS max_date, COUNT(*) AS records FROM clean"
    out["split_predicate_rows"] = (
        b
        + f"""
, days AS (SELECT CAST(order_date AS DATE) AS d, COUNT(*) AS n FROM raw WHERE order_date IS NOT NULL GROUP BY 1),
placed AS (SELECT d, n, (SUM(n) OVER (ORDER BY d) - n) * {SPLIT_PARTS} // SUM(n) OVER () AS part FROM days),
parts AS (SELECT part, MIN(d) AS f, SUM(n) AS n FROM placed GROUP BY part),
ends AS (SELECT chr(39) || f || chr(39) AS f, chr(39) || LEAD(f) OVER (ORDER BY part) || chr(39) AS t, n, ROW_NUMBER() OVER (ORDER BY part) AS k FROM parts)
SELECT CASE WHEN k = 1 THEN coalesce('order_date < ' || t, 'order_date IS NOT NULL')
  ELSE 'order_date >= ' || f || coalesce(' AND order_date < ' || t, '') END AS predicate, CAST(n AS BIGINT) AS rows FROM ends
UNION ALL SELECT 'order_date IS NULL', COUNT(*) FROM raw WHERE order_date IS NULL HAVING COUNT(*) > 0"""
    )
    out["incremental_regional_sales"] = out["vw_regional_sales"]
    out["incremental_data_quality"] = out["vw_data_quality"]
    out["incremental_issue_log"] = out["issue_log"]
    out["incremental_category_median"] = out["category_median"]
    out["incremental_top_orders"] = out["vw_top_orders"]
    out["bundle_category_sheet"] = out["report_category"]
    out["bundle_kpi_cards"] = out["kpi_cards"]
    out["bundle_raw_data"] = out["report_raw_data"]
    for k in _DASHBOARD:
        out[f"dashboard_{k}"] = out[k].replace("FROM clean ", "FROM filtered ")
    return out | EXTRA_ORACLES
