"""Orders stored by id, so that work per id needs no shuffle.

A bucketed and sorted table is shuffled once, when it is written.  Keep-first
de-duplication then reads each bucket in one task, and a join on the id of
two tables with equally many buckets meets bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.schema import ORDER_COLUMNS
from kpiforge.session import ensure_checkpoint_dir, scratch_path

ID = "order_id"


def write_bucketed(orders: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save ``orders`` as table ``table``, bucketed and sorted by order id, and read it.

    Rows are dealt by the bucket hash first, so each bucket is one file.
    Copies of one id lie in one bucket: a hot id makes one bucket larger
    than others, so this layout is for tables whose ids repeat a
    bounded number of times (over other tables ``cleaning.dedup_orders``
    thins copies before its shuffle and has no such bound).
    """
    writer = orders.repartition(buckets, ID).write.mode("overwrite").format("parquet").bucketBy(buckets, ID).sortBy(ID)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return orders.sparkSession.read.table(table)


def scratch_table(orders: DataFrame, name: str, buckets: int) -> DataFrame:
    """A bucketed copy under the shared checkpoint folder, with a table name of its own."""
    ensure_checkpoint_dir(orders.sparkSession)
    path = scratch_path(orders.sparkSession, name)
    return write_bucketed(orders, path.rsplit("/", 1)[1].replace("-", "_"), buckets, path)


def new_ids(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``arrivals`` whose id is not in ``known`` (both bucketed alike: a merge join without an exchange).

    A null id is a value of its own, as in de-duplication.
    """
    ids = known.select(ID).withColumnRenamed(ID, "_known")
    some = arrivals.where(F.col(ID).isNotNull()).join(ids.hint("merge"), F.col(ID) == F.col("_known"), "left_anti")
    if known.where(F.col(ID).isNull()).isEmpty():
        some = some.unionByName(arrivals.where(F.col(ID).isNull()))
    return some.select(*ORDER_COLUMNS)


def table_buckets(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions: they are its unit of parallel work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
