"""Join helpers: broadcast only what has been counted."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of a broadcast side: both its rows and the bytes of its values are checked.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: the length of text and binary columns, 16 for any other."""
    sizes = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16)
        for f in df.schema.fields
    ]
    total = F.lit(0).cast("long")
    for s in sizes:
        total = total + s
    return total


def _small(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether rows and bytes are within the bounds; reads ``max_rows + 1`` rows at most."""
    row = df.limit(max_rows + 1).select(value_bytes(df).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def size_checked_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, persist: bool = True
) -> DataFrame:
    """Return ``broadcast(df)`` if its rows and bytes are within the bounds, else ``df``.

    Only ``max_rows + 1`` rows are counted (each task stops early).  With
    ``persist`` (for small aggregates that are costly to recompute) the
    count and the join share one computation; dimension scans are cheap to
    re-read and are not persisted, so a large dimension is never cached.
    Beyond the bound the plain frame is returned and Spark plans a shuffle
    join (AQE's skew-join splits hot keys on the large side).
    """
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(df) if _small(df, max_rows, BROADCAST_MAX_BYTES) else df


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True if rows and bytes of ``df`` are within the bounds."""
    return _small(df, max_rows, BROADCAST_MAX_BYTES)


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """``broadcast(df)`` when a prior size check said it is small."""
    return F.broadcast(df) if small else df


def fits_broadcast_all(
    frames: dict[str, DataFrame], max_rows: int = BROADCAST_MAX_ROWS, early_stop: bool = False
) -> dict[str, bool]:
    """Size checks of several frames in one Spark job (one row of counts).

    For plain Parquet scans a row count reads only row-group metadata (no
    column is decoded), so a full count is cheap even for a large table.
    For frames that are costly to compute, ``early_stop`` cuts each one to
    ``max_rows + 1`` rows first (tasks stop early, at the price of one
    single-partition exchange per frame).
    """
    from kpiforge.operators.stats import named_counts

    parts = [
        (df.limit(max_rows + 1) if early_stop else df, {name: F.count(F.lit(1))})
        for name, df in frames.items()
    ]
    row = named_counts(parts).first()
    few = {name: df for name, df in frames.items() if row[name] <= max_rows}
    # the bytes of those that are short enough, again in one job
    sums = named_counts([(df.select(value_bytes(df).alias("b")), {name: F.coalesce(F.sum("b"), F.lit(0))}) for name, df in few.items()]).first() if few else {}
    return {name: name in few and sums[name] <= BROADCAST_MAX_BYTES for name in frames}


SALTS = 64


def salted_left_join(
    big: DataFrame, small: DataFrame, big_key: str, small_key: str, salt_columns: list[str],
    salts: int = SALTS,
) -> DataFrame:
    """Left join on one key that stays balanced when a key value is hot.

    Used where ``small`` is too big to broadcast.  Every ``small`` row is
    replicated once per salt; every ``big`` row gets a deterministic salt
    from a hash of ``salt_columns`` (same on retry), so the rows of a hot
    key spread over ``salts`` join tasks instead of one.
    """
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn(
        "_salt", F.pmod(F.hash(*[F.col(c) for c in salt_columns]), F.lit(salts))
    )
    cond = (salted_big[big_key] == salted_small[small_key]) & (
        salted_big["_salt"] == salted_small["_salt"]
    )
    return salted_big.join(salted_small, cond, "left").drop(salted_big["_salt"]).drop(
        salted_small["_salt"]
    )
