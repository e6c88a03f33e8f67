"""Small helpers for one-row summaries built from several frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named_counts(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row of named BIGINT aggregates, each computed over its own frame.

    Every frame is reduced by a partial + final aggregate to one row, the
    rows are turned into ``(metric, value)`` pairs and unioned, and a last
    global aggregate over those few pairs lays them out side by side.  No
    cross join, and identical sub-plans share their shuffles (exchange
    reuse) inside the one query.
    """
    pairs = []
    names: list[str] = []
    for df, aggs in parts:
        names.extend(aggs)
        one = df.agg(*[a.cast("long").alias(n) for n, a in aggs.items()])
        pairs.append(
            one.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value"))
                            for n in aggs
                        ]
                    )
                )
            )
        )
    union = pairs[0]
    for p in pairs[1:]:
        union = union.unionByName(p)
    return union.agg(
        *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
    )


def rows_of(df: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row frame into several rows (``inline`` of an array of structs)."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows]
    return df.select(F.inline(F.array(*structs)))
