"""Bounds and counts of a written table from Parquet footers.

Files keep the row count of every row group, and the least and greatest
value and the null count of every column.  With aggregate push-down the
Parquet source answers ``count``, ``min`` and ``max`` from them, without
reading a value.  Timestamps are not pushed, so the table carries the day of
an order as a DATE column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.schema import CLEAN_REVENUE_TYPE, ORDERS_SCHEMA

DAY, DATED = "order_day", "is_dated"
_PUSH = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def write_with_day(orders: DataFrame, path: str) -> None:
    """Write ``orders`` with the DATE column ``order_day``, each file sorted by it.

    Rows without a date go to a partition of their own: footers of files
    without any value of a column have no bounds to answer from.
    """
    laid = orders.withColumn("revenue", F.col("revenue").cast(CLEAN_REVENUE_TYPE)).withColumn(DAY, F.to_date("order_date")).withColumn(DATED, F.col("order_date").isNotNull())
    laid.sortWithinPartitions(DATED, DAY).write.mode("overwrite").partitionBy(DATED).parquet(path)


def _pushing(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose Parquet scans take aggregates (settings of the caller's stay as they are)."""
    beside = spark.newSession()
    for key, value in _PUSH.items():
        beside.conf.set(key, value)
    return beside


def _read(spark: SparkSession, path: str) -> DataFrame:
    # the schema is given: an empty table has no file to take it from
    money = {"revenue": CLEAN_REVENUE_TYPE}
    fields = [T.StructField(f.name, money.get(f.name, f.dataType)) for f in ORDERS_SCHEMA.fields]
    return _pushing(spark).read.schema(T.StructType([*fields, T.StructField(DAY, T.DateType()), T.StructField(DATED, T.BooleanType())])).parquet(path)


def _or_zero(count: Column) -> Column:
    """A pushed count is a sum over files, null without any; ``greatest`` skips nulls (``coalesce`` would be optimised away)."""
    return F.greatest(count, F.lit(0))


def table_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``[min_date, max_date, records]`` of a table that ``write_with_day`` wrote."""
    table = _read(spark, path)
    bounds = table.where(F.col(DATED)).agg(F.min(DAY).alias("min_date"), F.max(DAY).alias("max_date"))
    records = table.agg(_or_zero(F.count(F.lit(1))).alias("records"))
    return bounds.withColumn("_one", F.lit(1)).join(records.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def null_counts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: ``records`` and, per column, how many rows have no value."""
    table = _read(spark, path)
    counts = table.agg(_or_zero(F.count(F.lit(1))).alias("records"), *[_or_zero(F.count(F.col(c))).alias(c) for c in columns])
    return counts.select("records", *[(F.col("records") - F.col(c)).alias(c) for c in columns])
