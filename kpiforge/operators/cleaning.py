"""Cleaning and validation: fill, de-duplicate, drop negatives, flag future.

Order is fixed: fill missing revenue with the category median (computed on
all raw rows), keep the first row per ``order_id``, drop negative revenue,
count future-dated rows.  Each step is a lazy ``DataFrame -> DataFrame``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.expressions import as_of_literal, pct
from kpiforge.operators.joins import BROADCAST_MAX_ROWS, fits_broadcast, salted_left_join
from kpiforge.operators.median import group_median
from kpiforge.operators.stats import named_counts, rows_of
from kpiforge.session import materialize
from kpiforge.schema import (
    CLEAN_REVENUE_TYPE,
    DEDUP_ORDER,
    FUNNEL_STAGES,
    ISSUE_DUPLICATES,
    ISSUE_FINAL,
    ISSUE_FINAL_ACTION_PREFIX,
    ISSUE_FUTURE,
    ISSUE_MISSING,
    ISSUE_NEGATIVE,
    ORDER_COLUMNS,
)


def category_median(
    raw: DataFrame, approx_accuracy: int | None = None, **median_options
) -> DataFrame:
    """``DataFrame[category, median_revenue DECIMAL(18,4)]`` over all raw rows.

    Exact median of ``CAST(revenue AS DOUBLE)`` per category (negatives and
    future rows included, as in the reference), computed by distributed
    selection so a hot category never lands in one task.  The call runs the
    jobs and returns the written table (one row per category).  With
    ``approx_accuracy`` (off by default) a single ``percentile_approx``
    pass is used instead: bounded sketch memory, rank error at most
    ``rows / approx_accuracy``, and the result is an actual data value (no
    averaging of the two middle values).
    """
    if approx_accuracy:
        med = raw.groupBy("category").agg(
            F.percentile_approx(F.col("revenue").cast("double"), 0.5, approx_accuracy).alias("median")
        )
    else:
        med = group_median(raw, "category", "revenue", **median_options)
    # one row per category, written: its size check and every use read the
    # small table, and no frame stays cached
    return materialize(
        med.select("category", F.col("median").cast(CLEAN_REVENUE_TYPE).alias("median_revenue")), "category_median"
    )


def fill_missing_median(
    raw: DataFrame, medians: DataFrame | None = None, broadcast_rows: int = BROADCAST_MAX_ROWS
) -> DataFrame:
    """Replace missing revenue by the median of its category.

    The median table (one row per category) is broadcast after a size
    check; beyond ``broadcast_rows`` categories the rows without revenue go
    through a salted shuffle join.  Rows with a NULL category keep their revenue (the reference
    would blank it; we do not reproduce that data loss).
    """
    med = medians if medians is not None else category_median(raw)
    med = med.select(F.col("category").alias("_mcat"), F.col("median_revenue").alias("_med"))
    if fits_broadcast(med, broadcast_rows):
        joined = raw.join(F.broadcast(med), raw["category"] == med["_mcat"], "left")
    else:
        # too many categories to broadcast.  Only rows without revenue need the
        # median: those alone are joined (salted, so a hot category is spread),
        # the others keep their place and are not shuffled
        missing = F.col("revenue").isNull()
        joined = salted_left_join(raw.where(missing), med, "category", "_mcat", ORDER_COLUMNS)
        joined = joined.select(*ORDER_COLUMNS, "_med").unionByName(
            raw.where(~missing).select(*ORDER_COLUMNS, F.lit(None).cast(CLEAN_REVENUE_TYPE).alias("_med"))
        )
    return joined.select(
        *[
            F.coalesce(F.col("revenue").cast(CLEAN_REVENUE_TYPE), F.col("_med")).alias("revenue")
            if c == "revenue"
            else F.col(c)
            for c in ORDER_COLUMNS
        ]
    )


def dedup_order() -> list[Column]:
    """Total order deciding which copy of an id is kept: all columns, nulls last."""
    return [F.col(c).asc_nulls_last() for c in DEDUP_ORDER]


def dedup_orders(df: DataFrame) -> DataFrame:
    """Keep the first row per ``order_id`` (NULL ids form one group).

    ``row_number() = 1`` is planned with a partial ``WindowGroupLimit``
    before the shuffle, so each map task sends at most one row per id: a
    hot id repeated across a third of the table costs one row per task.
    """
    w = Window.partitionBy("order_id").orderBy(*dedup_order())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def is_kept() -> Column:
    """Revenue is not negative, or still missing."""
    return F.col("revenue").isNull() | (F.col("revenue") >= 0)


def drop_negative(df: DataFrame) -> DataFrame:
    """Drop rows with negative revenue; rows still missing revenue are kept."""
    return df.where(is_kept())


def clean_orders(raw: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Fill, de-duplicate and drop negatives, in that order."""
    return drop_negative(dedup_orders(fill_missing_median(raw, medians)))


def future_flag(as_of=None) -> Column:
    """Order later than the reporting instant (timestamp comparison)."""
    return F.col("order_date") > as_of_literal(as_of)


def _is_negative() -> Column:
    return F.col("revenue") < 0


def issue_log(raw: DataFrame, deduped: DataFrame, as_of=None) -> DataFrame:
    """``DataFrame[step, issue_type, issue_count, action]`` of the cleaning run.

    A row appears only when its count is non-zero, except the final
    ``Records After Cleaning`` row which is always there.  Duplicates are
    raw rows minus de-duplicated rows (NULL ids count as one value);
    negatives are counted after de-duplication; future dates on the clean
    rows.  Clean rows are the de-duplicated rows without negatives, so
    two scans (raw, de-duplicated) give every count.
    """
    kept = ~_is_negative() | F.col("revenue").isNull()
    counts = named_counts(
        [
            (raw, {"raw_rows": F.count(F.lit(1)), "missing": F.count_if(F.col("revenue").isNull())}),
            (
                deduped,
                {
                    "dedup_rows": F.count(F.lit(1)),
                    "negative": F.count_if(_is_negative()),
                    "clean_rows": F.count_if(kept),
                    "future": F.count_if(kept & future_flag(as_of)),
                },
            ),
        ]
    )
    return issue_rows(counts)


def issue_rows(counts: DataFrame) -> DataFrame:
    """The issue log from one row of counts (``raw_rows``, ``missing``, ``dedup_rows``, ``negative``, ``clean_rows``, ``future``)."""
    lit = F.lit
    rows = [
        [lit(1), lit(ISSUE_MISSING[0]), F.col("missing"), lit(ISSUE_MISSING[1])],
        [lit(2), lit(ISSUE_DUPLICATES[0]), F.col("raw_rows") - F.col("dedup_rows"), lit(ISSUE_DUPLICATES[1])],
        [lit(3), lit(ISSUE_NEGATIVE[0]), F.col("negative"), lit(ISSUE_NEGATIVE[1])],
        [lit(4), lit(ISSUE_FUTURE[0]), F.col("future"), lit(ISSUE_FUTURE[1])],
        [
            lit(5),
            lit(ISSUE_FINAL),
            F.col("clean_rows"),
            F.concat(lit(ISSUE_FINAL_ACTION_PREFIX), F.col("raw_rows").cast("string")),
        ],
    ]
    log = rows_of(counts, rows, ["step", "issue_type", "issue_count", "action"])
    return log.where((F.col("issue_count") > 0) | (F.col("issue_type") == ISSUE_FINAL))


def severity(count: Column, issue_type: Column) -> Column:
    """``warn`` for a non-zero count on a problem row, ``ok`` otherwise."""
    return F.when((count > 0) & ~issue_type.contains("Records"), "warn").otherwise("ok")


def issue_severity(log: DataFrame) -> DataFrame:
    """The issue log with a severity column (report colour coding)."""
    return log.withColumn("severity", severity(F.col("issue_count"), F.col("issue_type")))


def null_profile(raw: DataFrame) -> DataFrame:
    """``DataFrame[column_position, column_name, missing_count, missing_pct]``.

    One scan counts the missing values of all nine columns, then the
    single summary row is turned into one row per column.
    """
    one = raw.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in ORDER_COLUMNS],
    )
    return null_rows(one, F.col("_total"))


def null_rows(one: DataFrame, total: Column, prefix: str = "") -> DataFrame:
    """The null profile from one row of missing counts, ``<prefix><column>`` each."""
    rows = [
        [F.lit(i + 1), F.lit(c), F.col(f"{prefix}{c}"), total] for i, c in enumerate(ORDER_COLUMNS)
    ]
    prof = rows_of(one, rows, ["column_position", "column_name", "missing_count", "_total"])
    return prof.select(
        "column_position",
        "column_name",
        "missing_count",
        pct(F.col("missing_count"), F.col("_total")).alias("missing_pct"),
    )


def null_profile_nonzero(raw: DataFrame) -> DataFrame:
    """Only the columns that have missing values (chart input)."""
    return null_profile(raw).where(F.col("missing_count") > 0)


def record_funnel(raw: DataFrame, deduped: DataFrame, report_filter: Column | None = None) -> DataFrame:
    """``DataFrame[stage_order, stage, records]``: counts at each stage.

    Computed, not constants: raw rows, de-duplicated rows, cleaned rows,
    rows left after the report filters (``report_filter`` on clean rows).
    Two scans: raw and de-duplicated.
    """
    kept = ~_is_negative() | F.col("revenue").isNull()
    shown = kept if report_filter is None else kept & report_filter
    one = named_counts(
        [
            (raw, {"s1": F.count(F.lit(1))}),
            (deduped, {"s2": F.count(F.lit(1)), "s3": F.count_if(kept), "s4": F.count_if(shown)}),
        ]
    )
    return funnel_rows(one, {s: f"s{i + 1}" for i, s in enumerate(FUNNEL_STAGES)})


def funnel_rows(one: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The record funnel from one row of counts; ``columns``: stage -> column."""
    rows = [[F.lit(i + 1), F.lit(s), F.col(c)] for i, (s, c) in enumerate(columns.items())]
    return rows_of(one, rows, ["stage_order", "stage", "records"])
