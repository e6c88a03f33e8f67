"""Writers: filtered orders as CSV, and the report bundle.

Executors write their partitions directly; nothing passes through the
driver.  Output is sharded by default (one file per task);
``single_file=True`` is for small outputs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.schema import CLEAN_REVENUE_TYPE, ORDERS_SCHEMA

# Written and read with the same rules: spaces kept, quotes doubled, a missing
# value is nothing at all and an empty text is a pair of quotes.
CSV_OPTIONS = {
    "header": "true",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
}
DATE_ONLY = "yyyy-MM-dd"


def _timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]


def csv_ready(df: DataFrame) -> DataFrame:
    """Timestamps as text: the date alone if every row of the column is a midnight, else with the time.

    One pass over the timestamp columns decides, so no time of day is lost.
    """
    stamps = _timestamp_columns(df)
    if not stamps:
        return df
    midnight = df.agg(*[F.bool_and(F.col(f"`{c}`") == F.date_trunc("day", F.col(f"`{c}`"))).alias(c) for c in stamps]).first()

    def text(c: str) -> Column:
        col = F.col(f"`{c}`")
        if midnight[c] is not False:
            return F.date_format(col, DATE_ONLY)
        whole = F.date_trunc("second", col) == col
        return F.when(whole, F.date_format(col, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"))

    return df.select(*[text(c).alias(c) if c in stamps else F.col(f"`{c}`") for c in df.columns])


def export_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Write rows as CSV with a header; values read back unchanged (``csv_ready``).

    ``single_file`` gathers the finished rows in one task by a shuffle, so
    the work before it stays parallel; only for small outputs.
    """
    out = csv_ready(df)
    out = out.repartition(1) if single_file else out
    out.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def csv_name(as_of: dt.datetime | None = None) -> str:
    """Name of a CSV export of the filtered orders, ``filtered_orders_YYYYMMDD.csv``."""
    return f"filtered_orders_{(as_of or _now()).strftime('%Y%m%d')}.csv"


def _now() -> dt.datetime:
    """The one clock of stamps and names: UTC."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


EMPTY_TEXT = "\u0000"  # stands for a quoted empty field while reading, which Spark would else take for a missing value


def read_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str] | None = None) -> DataFrame:
    """Read CSV by the rules of ``export_csv`` with a declared schema; a broken record raises."""
    reader = (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS)
        .option("emptyValue", EMPTY_TEXT)
        .option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]")
        .option("multiLine", "true")
        .option("mode", "FAILFAST")
        .options(**(options or {}))
    )
    return reader.csv(path).select(
        *[
            F.when(F.col(f.name) == EMPTY_TEXT, F.lit("")).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def read_exported_orders(spark: SparkSession, path: str) -> DataFrame:
    """Read an orders CSV export back with the declared schema (clean revenue scale)."""
    schema = T.StructType(
        [
            T.StructField(f.name, CLEAN_REVENUE_TYPE if f.name == "revenue" else f.dataType, True)
            for f in ORDERS_SCHEMA.fields
        ]
    )
    return read_csv(spark, path, schema)


def bundle_stamp(as_of: dt.datetime | None = None) -> str:
    """Folder name of one report run, ``YYYYMMDD_HHMM``."""
    return (as_of or _now()).strftime("%Y%m%d_%H%M")


def write_bundle(
    tables: dict[str, DataFrame],
    out_dir: str,
    stamp: str,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Write each report table to ``<out_dir>/<stamp>/<name>``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{stamp}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            csv_ready(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
        else:
            writer.format(fmt).save(path)
        paths[name] = path
    return paths
