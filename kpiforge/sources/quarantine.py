"""Tolerant input: every record is kept, as an order or as a refused record with its reasons.

Files are read as lines and parsed with all fields as text (PERMISSIVE, with
a corrupt-record column), so a broken record ends neither the job nor its
neighbours.  Fields are then cast with ``try_cast``; a text that is there
but does not make a value of its column refuses the record instead of
becoming a silent null, and so does a value that the cast would change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.schema import ORDER_COLUMNS, ORDERS_SCHEMA

MALFORMED = "record: malformed"
_CORRUPT = "_corrupt"
_TEXTS = T.StructType([T.StructField(c, T.StringType()) for c in ORDER_COLUMNS] + [T.StructField(_CORRUPT, T.StringType())])
# What a date or time of day must look like; casts alone also take years and other short forms.
_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
_INTEGER = r"^[+-]?\d+$"


@dataclass
class Quarantine:
    """``orders`` have the declared schema; ``refused`` have ``record`` (the line as it came) and ``reason``."""

    orders: DataFrame
    refused: DataFrame


def read_texts(spark: SparkSession, path: str, fmt: str = "csv", options: dict[str, str] | None = None) -> DataFrame:
    """Records of line-based files (``csv`` or ``json``): ``record``, all order columns as text, and ``malformed``.

    Blank lines are no records.  CSV columns are those of the orders table
    in their order; lines that repeat the column names are headers.  A CSV
    record with too few or too many fields, or JSON that cannot be parsed,
    is malformed.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"tolerant reading knows csv and json, not {fmt}")
    # quotes inside a quoted field are doubled, as spreadsheets and pandas write them
    options = {"escape": '"', **(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    lines = spark.read.text(path).withColumnRenamed("value", "record").where(F.trim("record") != "")
    if fmt == "csv":
        sep = options.get("sep", ",")
        lines = lines.where(F.lower(F.replace(F.col("record"), F.lit('"'))) != F.lit(sep.join(ORDER_COLUMNS)))
        parsed = F.from_csv("record", _TEXTS.simpleString(), options)
    else:
        parsed = F.from_json("record", _TEXTS, options)
    rows = lines.select("record", parsed.alias("p"))
    malformed = F.col("p").isNull() | F.col(f"p.{_CORRUPT}").isNotNull()
    return rows.select("record", *[F.col(f"p.{c}").alias(c) for c in ORDER_COLUMNS], malformed.alias("malformed"))


def _parsed(name: str, kind: T.DataType) -> tuple[Column, Column]:
    """The value of a text field, and the reason why it has none (null if all is well)."""
    raw = F.trim(F.col(name))
    given = raw.isNotNull() & (raw != "")
    if isinstance(kind, T.StringType):
        return F.col(name), F.lit(None).cast("string")
    value = raw.try_cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        value = F.when(raw.rlike(_DATE), value)
        return value, F.when(given & value.isNull(), F.lit(f"{name}: not a date"))
    if isinstance(kind, T.DecimalType):
        exact = raw.try_cast(T.DecimalType(38, 12))
        why = F.when(exact.isNull() & raw.try_cast("double").isNull(), f"{name}: not a number").when(value.isNull() | exact.isNull(), f"{name}: out of range")
        return value, F.when(given, why.when(exact != value, f"{name}: more than {kind.scale} decimals"))
    value = F.when(raw.rlike(_INTEGER), value)
    return value, F.when(given & value.isNull(), F.when(raw.rlike(_INTEGER), f"{name}: out of range").otherwise(f"{name}: not an integer"))


def judged(texts: DataFrame) -> DataFrame:
    """``texts`` with the order columns cast, and ``reason`` (null for good records; several are joined by ``; ``)."""
    fields = [(f.name, *_parsed(f.name, f.dataType)) for f in ORDERS_SCHEMA.fields]
    found = F.concat_ws("; ", *[why for _, _, why in fields])
    reason = F.when(F.col("malformed"), MALFORMED).otherwise(F.nullif(found, F.lit("")))
    return texts.select(*[value.alias(name) for name, value, _ in fields], reason.alias("reason"), "record")


def split(texts: DataFrame) -> Quarantine:
    """Good records as orders, all others as they came with their reasons."""
    rows = judged(texts)
    return Quarantine(rows.where(F.col("reason").isNull()).select(*ORDER_COLUMNS), rows.where(F.col("reason").isNotNull()).select("record", "reason"))


def read_orders_tolerant(spark: SparkSession, path: str, fmt: str = "csv", options: dict[str, str] | None = None) -> Quarantine:
    """Read a flat orders file that may hold broken records."""
    return split(read_texts(spark, path, fmt, options))


def refused_summary(refused: DataFrame) -> DataFrame:
    """``[reason, records]``: a record with several reasons counts under each."""
    return refused.select(F.explode(F.split("reason", "; ")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("records")).orderBy(
        F.col("records").desc(), "reason"
    )
