"""Partitioning helpers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of source files whose rows one task of a written layout gets.
PART_BYTES = 8 << 20
# Rows that one task of a shuffle gets, if they are spread evenly.
TASK_ROWS = 500_000


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread ``df`` over the cluster's cores if its scan has fewer splits.

    A Parquet file with a single row group is one split, so everything
    pipelined after the scan runs in one task.  Large inputs already have
    at least one split per core and are returned unchanged (no shuffle).
    Rows are hashed on their position in the scan: identical copies still
    land in different partitions, and right after a file scan the
    position is the same on a retry (no sort needed, unlike round-robin).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, F.monotonically_increasing_id())


def parts_by_size(df: DataFrame, least: int, part_bytes: int = PART_BYTES) -> int:
    """Parts to deal ``df`` to: one for each ``part_bytes`` of the files it is read from, ``least`` at least.

    A multiple of ``least``, so parts can be handed on in ``least`` equal
    lots.  Only file lengths are looked at, no rows; a frame without files
    gets ``least``.
    """
    spark = df.sparkSession
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))  # names come escaped
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return least * max(1, -(-size // (part_bytes * least)))


def parts_by_rows(rows: int) -> int:
    """Parts for a shuffle of ``rows``: one for each ``TASK_ROWS``."""
    return -(-rows // TASK_ROWS)


@contextmanager
def shuffles_into(spark: SparkSession, parts: int):
    """Shuffles of ``spark`` inside the block have ``parts`` parts, if the session asks for fewer.

    AQE joins parts that turn out small.  The session's own setting is back
    at the end of the block.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), parts)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
