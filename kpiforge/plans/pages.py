"""Any page of the ordered preview, at the price of the rows it shows.

The clean orders are written once in preview order: range partitions, each
sorted, a folder per partition.  An order-statistic index keeps how many
rows every partition holds and how many come before it.  Page *n* is then
found in the index (a row per partition) and read from the one or two
partitions that it lies in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.operators.partitioning import parts_by_size
from kpiforge.schema import CLEAN_REVENUE_TYPE, DEDUP_ORDER, ORDER_COLUMNS, ORDERS_SCHEMA, PREVIEW_LIMIT
from kpiforge.session import ensure_checkpoint_dir, scratch_path

PART = "page_part"
_STORED = T.StructType(
    [T.StructField(f.name, CLEAN_REVENUE_TYPE if f.name == "revenue" else f.dataType) for f in ORDERS_SCHEMA.fields]
    + [T.StructField(PART, T.IntegerType())]
)


def preview_order() -> list[Column]:
    """By date, then id, then every other column: a total order of de-duplicated orders."""
    return [F.col(c).asc_nulls_last() for c in ["order_date", "order_id"] + DEDUP_ORDER[1:]]


@dataclass
class Pages:
    """The ordered table under ``path`` and its index ``[page_part, rows, before]``."""

    spark: SparkSession
    path: str
    index: DataFrame

    def total(self) -> int:
        return self.index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def page(self, number: int, size: int = PREVIEW_LIMIT) -> DataFrame:
        """Rows of page ``number`` (from 0) with their ``position`` in the whole table (from 1); empty beyond the last."""
        if number < 0 or size < 1:
            raise ValueError("pages count from 0 and have at least one row")
        first = number * size
        inside = self.index.where((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first))
        parts = {r[PART]: r["before"] for r in inside.collect()}  # those the page lies in
        rows = self.spark.read.schema(_STORED).parquet(f"{self.path}/rows").where(F.col(PART).isin(sorted(parts)))
        rows = rows.orderBy(*preview_order()).offset(max(0, first - min(parts.values(), default=first))).limit(size)
        place = F.row_number().over(Window.partitionBy().orderBy(*preview_order()))  # one page
        return rows.select(*ORDER_COLUMNS, (place + first).cast("long").alias("position")).orderBy("position")


def write_pages(orders: DataFrame, path: str | None = None, parts: int | None = None) -> Pages:
    """Write ``orders`` in preview order as range partitions: ``parts`` (by default the session's shuffle partitions),
    each cut further as the size of the orders asks for, so the rows that one task sorts stay bounded."""
    spark = orders.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or scratch_path(spark, "pages")
    parts = parts_by_size(orders, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    typed = orders.select(*ORDER_COLUMNS).withColumn("revenue", F.col("revenue").cast(CLEAN_REVENUE_TYPE))
    laid = typed.repartitionByRange(parts, *preview_order()).sortWithinPartitions(*preview_order())
    laid.withColumn(PART, F.spark_partition_id()).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    counts = spark.read.schema(_STORED).parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy().orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # a row per partition
    return open_pages(spark, path)


def open_pages(spark: SparkSession, path: str) -> Pages:
    return Pages(spark, path, spark.read.schema(f"{PART} int, rows long, before long").parquet(f"{path}/index"))
