"""Split bounds for partitioned reads: parts of about equal size whatever the dates look like.

Ranges of equal width leave a busy year to one reader.  Here the rows are
counted per day (a few thousand numbers, whatever the table's size) and days
are dealt to parts by their cumulative count.  A day is never cut, so every
row lies in exactly one part; rows without a date get a part of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equal_depth_parts(orders: DataFrame, parts: int, column: str = "order_date") -> DataFrame:
    """``[part, first_day, last_day, rows]``, parts from 0 by day; part -1 holds the rows without a date, if any.

    A part ends with the day on which its share of all dated rows is full.
    Shares that a single busy day fills several times over leave their
    numbers unused.
    """
    if parts < 1:
        raise ValueError("at least one part")
    days = orders.groupBy(F.to_date(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    dated = days.where(F.col("day").isNotNull())
    by_day = Window.partitionBy().orderBy("day")  # one row per day
    placed = dated.withColumn("before", F.sum("n").over(by_day) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    out = placed.withColumn("part", F.expr(f"CAST(before * {parts} div total AS INT)")).groupBy("part").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("rows"))
    none = days.where(F.col("day").isNull()).select(F.lit(-1).alias("part"), F.col("day").alias("first_day"), F.col("day").alias("last_day"), F.col("n").alias("rows"))
    return out.unionByName(none)


def split_predicates(parts: DataFrame, column: str = "order_date") -> list[str]:
    """One SQL predicate per part, for ``spark.read.jdbc(..., predicates=...)``: every row satisfies exactly one.

    The first and last part are open at their ends, so rows that arrive
    meanwhile with earlier or later dates are read as well; there is always
    a predicate for rows without a date.
    """
    firsts = [r["first_day"].isoformat() for r in parts.where("part >= 0").orderBy("part").collect()]  # as many rows as parts
    out = [f"{column} IS NULL"]
    for k in range(len(firsts)):
        ends = ([f"{column} >= '{firsts[k]}'"] if k else []) + ([f"{column} < '{firsts[k + 1]}'"] if k + 1 < len(firsts) else [])
        out.append(" AND ".join(ends) or f"{column} IS NOT NULL")
    return out if firsts else [*out, f"{column} IS NOT NULL"]


def rows_by_predicate(orders: DataFrame, predicates: list[str]) -> DataFrame:
    """``[predicate, rows]``: how many rows each predicate reads (one pass)."""
    flags = F.array(*[F.when(F.expr(p), F.lit(p)) for p in predicates])
    return orders.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("predicate")).groupBy("predicate").agg(F.count(F.lit(1)).alias("rows"))
