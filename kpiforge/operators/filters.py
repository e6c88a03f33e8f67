"""Report filters (date range, category, region, status) and their domains."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.expressions import ts_literal
from kpiforge.schema import ALL


def as_date(value: str | dt.date) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value).strip())  # a time of day or trailing text is refused


def in_list(column: str, values: Sequence[str] | None) -> Column | None:
    """``column IN values``; an empty list or one containing ``All`` means no filter."""
    if not values or ALL in values:
        return None
    return F.col(column).isin(list(values))


def date_range(date_from=None, date_to=None) -> Column | None:
    """Inclusive date range on the date part of ``order_date``.

    Written as ``order_date >= from AND order_date < to + 1 day`` on the raw
    timestamp, so it pushes into a Parquet scan; NULL dates drop out.
    """
    preds = []
    if date_from is not None:
        preds.append(F.col("order_date") >= ts_literal(as_date(date_from)))
    if date_to is not None:
        preds.append(F.col("order_date") < ts_literal(as_date(date_to) + dt.timedelta(days=1)))
    return _and(preds)


def _and(preds: list[Column | None]) -> Column | None:
    out = None
    for p in preds:
        if p is not None:
            out = p if out is None else out & p
    return out


def order_filter(
    date_from=None,
    date_to=None,
    categories: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
) -> Column | None:
    """The AND of all given filters as one predicate (``None``: no filter)."""
    return _and(
        [
            date_range(date_from, date_to),
            in_list("category", categories),
            in_list("region", regions),
            in_list("status", statuses),
        ]
    )


def filter_orders(
    df: DataFrame,
    date_from=None,
    date_to=None,
    categories: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
) -> DataFrame:
    """All given filters combined with AND; absent ones are skipped."""
    pred = order_filter(date_from, date_to, categories, regions, statuses)
    return df if pred is None else df.where(pred)


def date_bounds(df: DataFrame) -> DataFrame:
    """``DataFrame[min_date, max_date]``: default bounds of the date filter."""
    return df.agg(
        F.to_date(F.min("order_date")).alias("min_date"),
        F.to_date(F.max("order_date")).alias("max_date"),
    )


DOMAIN_COLUMNS = ("category", "region", "status")


def filter_domains(df: DataFrame, columns: Sequence[str] = DOMAIN_COLUMNS) -> DataFrame:
    """``DataFrame[column_name, position, value]``: ``All`` then sorted distinct values.

    The distinct values are found by a partially aggregated group-by on
    (column, value); only the few distinct values per column are ranked.
    """
    pairs = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]
            )
        )
    ).where(F.col("value").isNotNull())
    distinct = pairs.distinct()
    ranked = distinct.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("column_name").orderBy("value")) + 1,
    )
    all_rows = df.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(1).alias("position"),
                        F.lit(ALL).alias("value"),
                    )
                    for c in columns
                ]
            )
        )
    )
    return all_rows.unionByName(ranked.select("column_name", "position", "value"))
