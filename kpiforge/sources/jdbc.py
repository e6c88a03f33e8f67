"""Reading views or tables over JDBC (e.g. PostgreSQL KPI views).

No database is started or contacted in tests; the options builder is
unit-tested and ``read_jdbc`` is a thin call to Spark's JDBC source.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower_bound: str | int | dt.date | None = None,
    upper_bound: str | int | dt.date | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``.

    A large table is read in ``num_partitions`` parallel range queries on
    ``partition_column`` (e.g. ``order_date``); a small view is one query.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts: dict[str, str] = {"url": url, "fetchsize": str(fetch_size)}
    if table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query  # type: ignore[assignment]
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    bounds = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(b is not None for b in bounds):
        if any(b is None for b in bounds):
            raise ValueError(
                "partition_column, lower_bound, upper_bound and num_partitions go together"
            )
        if query is not None:
            raise ValueError("partitioned reads need table, not query")
        if int(num_partitions) < 1:  # type: ignore[arg-type]
            raise ValueError("num_partitions must be positive")
        opts["partitionColumn"] = partition_column  # type: ignore[assignment]
        opts["lowerBound"] = str(lower_bound)
        opts["upperBound"] = str(upper_bound)
        opts["numPartitions"] = str(num_partitions)
    return opts


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Read a table or view through Spark's JDBC source."""
    return spark.read.format("jdbc").options(**options).load()
