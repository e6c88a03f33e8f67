"""The batch job: read -> clean -> validate -> load (write every table).

``run_etl`` is what ``spark-submit -m kpiforge`` runs.  The raw orders are
read for the median histogram, for the raw counts (missing values per
column, negatives, future dates: one aggregate) and for the de-duplicated
orders, which are written once.  Everything else comes from that table: its
counts, a day-grain rollup that all sums are taken from, distinct customers,
the top orders and the filtered rows.  Scratch tables are deleted at the end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.expressions import as_of_literal, exact_ratio, money, month_text, pct
from kpiforge.operators import cleaning, metrics
from kpiforge.operators.cleaning import is_kept
from kpiforge.plans import report
from kpiforge.plans.rollup import add_up, order_rollup, region_customers, rollup_views
from kpiforge.plans.tables import MONTH_COLUMN, FilterSpec, OrderTables
from kpiforge.plans.views import quality_rows
from kpiforge.schema import CANCELLED, COMPLETED, FUNNEL_STAGES, HEAD_CATEGORY, HEAD_REGIONAL, HEAD_TREND, ORDER_COLUMNS
from kpiforge.session import materialize, scratch_scope
from kpiforge.sinks.files import bundle_stamp, write_bundle

CLEAN_FLAG = "is_clean"


def raw_counts(raw: DataFrame, as_of=None) -> DataFrame:
    """One row with every count over raw orders, from one pass."""
    today = F.to_date(as_of_literal(as_of)).cast("timestamp_ntz")
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("order_date") > today).alias("future_raw"),
        F.count_if(F.col("revenue") < 0).alias("negative_raw"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ORDER_COLUMNS],
    )


def order_counts(deduped: DataFrame, filters: FilterSpec, as_of=None) -> DataFrame:
    """One row with every count over de-duplicated orders, from one pass."""
    kept, shown = is_kept(), filters.predicate()
    return deduped.agg(
        F.count(F.lit(1)).alias("dedup_rows"),
        F.count("order_id").alias("known_ids"),
        F.count_if(~kept).alias("negative"),
        F.count_if(kept).alias("clean_rows"),
        F.count_if(kept & cleaning.future_flag(as_of)).alias("future"),
        F.count_if(kept if shown is None else kept & shown).alias("shown_rows"),
    )


def report_from_rollup(rollup: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """KPI row and the three summed report sheets from the filtered rollup and customer pairs."""
    done, cancelled = F.col("status") == COMPLETED, F.col("status") == CANCELLED

    def total(c: str, cond):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    sums = rollup.agg(
        total("revenue", done).alias("rev"),
        total("priced", done).alias("priced"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        total("rows", cancelled).alias("cancelled"),
        total("rows", done).alias("done"),
    )
    people = pairs.agg(F.count_distinct("customer_id").alias("people"))
    one = sums.withColumn("_one", F.lit(1)).join(people.withColumn("_one", F.lit(1)), "_one")  # one row each
    kpis = one.select(
        money("rev").alias("total_revenue"),
        F.col("rows").alias("total_orders"),
        exact_ratio(F.col("rev"), F.col("priced"), 4).alias("avg_order_value"),
        pct(F.col("cancelled"), F.col("rows")).alias("cancellation_rate"),
        F.col("done").alias("completed_orders"),
        F.col("people").alias("unique_customers"),
    )
    completed = rollup.where(done)
    revenue = money(F.coalesce("revenue", F.lit(0)))
    h = HEAD_CATEGORY
    category = (
        add_up(completed.where(F.col("category").isNotNull()), "category")
        .select(
            F.col("category").alias(h[0]),
            F.col("orders").alias(h[1]),
            revenue.alias(h[2]),
            exact_ratio(F.col("revenue"), F.col("priced"), 4).alias(h[3]),
            F.coalesce("units", F.lit(0)).alias(h[4]),
        )
        .orderBy(F.col(f"`{h[2]}`").desc_nulls_last(), F.col(f"`{h[0]}`"))
    )
    h = HEAD_TREND
    trend = (
        add_up(completed.where(F.col("sale_date").isNotNull()), month_text("sale_date").alias(h[0]))
        .select(h[0], revenue.alias(h[1]), F.col("orders").alias(h[2]))
        .orderBy(h[0])
    )
    h = HEAD_REGIONAL
    regional = add_up(rollup.where(F.col("region").isNotNull()), "region").join(region_customers(pairs), "region", "left")
    regional = regional.select(
        F.col("region").alias(h[0]), F.col("orders").alias(h[1]), revenue.alias(h[2]), F.col("unique_customers").alias(h[3])
    ).orderBy(F.col(f"`{h[2]}`").desc_nulls_last(), F.col(f"`{h[0]}`"))
    return {"kpi_cards": report.kpi_cards(kpis), "category": category, "revenue_trend": trend, "regional": regional}


def run_etl(
    raw: DataFrame,
    out_dir: str,
    as_of: dt.datetime | str | None = None,
    filters: FilterSpec | None = None,
    stamp: str | None = None,
    fmt: str = "parquet",
    partition_by_month: bool = False,
) -> dict[str, str]:
    """Clean ``raw`` and write all tables; returns table name -> path."""
    if as_of is None:
        as_of = dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)
    if stamp is None:
        when = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
        stamp = bundle_stamp(when)
    spark, filters = raw.sparkSession, filters or FilterSpec()
    folder = f"{out_dir.rstrip('/')}/{stamp}"
    with scratch_scope(spark):
        t = OrderTables(raw, as_of=as_of, filters=filters)
        # written once: clean rows and dropped ones side by side, each file sorted by date
        laid = cleaning.dedup_orders(t.filled).withColumn(CLEAN_FLAG, is_kept())
        parts = [CLEAN_FLAG]
        if partition_by_month:
            parts.append(MONTH_COLUMN)
            laid = laid.withColumn(MONTH_COLUMN, F.date_format("order_date", "yyyy-MM")).repartitionByRange("order_date", "order_id")
        else:
            laid = laid.sortWithinPartitions(CLEAN_FLAG, "order_date")
        laid.write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/orders")
        stored = spark.read.parquet(f"{folder}/orders")
        clean = stored.where(F.col(CLEAN_FLAG) == "true")  # a partition: the other rows' files are not opened
        month = filters.month_predicate() if partition_by_month else None
        filtered = filters.apply(clean if month is None else clean.where(month)).select(*ORDER_COLUMNS)
        clean = clean.select(*ORDER_COLUMNS)

        # one small written table: all counts of raw and of de-duplicated orders
        left = raw_counts(raw, as_of).withColumn("_one", F.lit(1))
        counts = left.join(order_counts(stored, filters, as_of).withColumn("_one", F.lit(1)), "_one").drop("_one")
        counts = materialize(counts, "counts")
        rollup = materialize(order_rollup(clean), "rollup")
        pairs = materialize(filtered.select("region", "customer_id").distinct(), "customers")

        shown = filters.apply(rollup.withColumn("order_date", F.col("sale_date").cast("timestamp_ntz"))).drop("order_date")
        issues = cleaning.issue_rows(counts.withColumn("missing", F.col("missing_revenue")))
        tables: dict[str, DataFrame] = {
            "category_median": t.medians,
            "issue_log": cleaning.issue_severity(issues),
            "null_profile": cleaning.null_rows(counts, F.col("raw_rows"), "missing_"),
            "record_funnel": cleaning.funnel_rows(counts, dict(zip(FUNNEL_STAGES, ["raw_rows", "dedup_rows", "clean_rows", "shown_rows"]))),
            **rollup_views(rollup, region_customers(clean), metrics.top_completed(clean), as_of),
            "vw_data_quality": quality_rows(
                counts, F.col("missing_revenue"), F.col("raw_rows") - F.col("known_ids"), F.col("future_raw"), F.col("negative_raw"), as_of
            ),
        }
        paths = write_bundle(tables, out_dir, stamp, fmt=fmt)
        sheets = report_from_rollup(shown, pairs) | {
            "data_quality": report.report_quality(issues, as_of),
            "raw_data": report.report_raw_data(filtered),
        }
        paths |= {f"report/{k}": v for k, v in write_bundle(sheets, folder, "report", fmt=fmt).items()}
    paths["clean_orders"] = f"{folder}/orders/{CLEAN_FLAG}=true"
    return paths
