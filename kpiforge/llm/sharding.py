"""Sharding by rendezvous hashing.

Every (key, shard) pair gets a uniform draw from a hash; a record goes to
the shard with the largest weighted score ``-weight / ln(draw)``.  Key and
shard list alone decide, so adding a shard moves records only into it, about
its share of them.  Slots are numbered by two-level counting, so no shard's
rows ever meet in one task.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import boxed, prepare, unboxed, written

# Sub-buckets of a shard: their counts, shards x SLOT_BUCKETS rows at most, are broadcast.
SLOT_BUCKETS = 256


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of ``key``: the best weighted score, the smallest number on a tie.

    A shard with weight 0 gets nothing.  A null key has a shard like any other.
    """
    live = [(s, float(w)) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")

    def score(shard: int, weight: float) -> Column:
        # 52 bits of the hash as a number strictly between 0 and 1
        draw = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 12).cast("double") + 0.5) / float(1 << 52)
        return F.lit(-weight) / F.log(draw)

    # greatest() of structs compares scores first, then the negated shard number
    best = [F.struct(score(s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in live]
    return (-(F.greatest(*best) if len(best) > 1 else best[0])["shard"]).cast("int")


def assign(df: DataFrame, key_col: str, weights: Sequence[float]) -> DataFrame:
    """``df`` with ``shard``: the shard of each row's key under ``weights``, one per shard."""
    return unboxed(
        boxed(df, shard=rendezvous(F.col(f"`{key_col}`"), weights)), df.columns, add={"shard": F.col("shard")}
    )


def shard_rows(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row by the ``key`` law, and its shard after one more of weight 1.

    Returns the id column, ``size`` (UTF-8 bytes of the text plus 1),
    ``text_crc32``, ``law``, ``shard``, ``slot`` (gapless from 0 in each
    shard) and ``grown_shard``.

    Edge cases: null text has size 1 and the checksum of nothing; rows with
    a null id share one shard, as do rows with equal ids; repeated rows each
    get a slot; other columns are not read; an empty table gives an empty
    table.  A shard (or an id) with a third of all rows is numbered in
    SLOT_BUCKETS parts, dealt by a hash of the row and its position.
    """
    prepare(docs.sparkSession)
    weights = list(weights) if weights is not None else [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight per shard")
    key, data = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(
        key.alias("id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("crc"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = written(rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(SLOT_BUCKETS)).cast("int")), "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place"))
    numbered = rows.withColumn("k", within).join(F.broadcast(first), ["shard", "bucket"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("k") - 1).cast("long").alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, key_col: str, weights: Sequence[float]) -> None:
    """Write ``df`` as Parquet folders ``shard=<n>`` under ``path``, all columns kept.

    A rebalanced exchange splits large shards over several files and tasks.
    """
    out = assign(df, key_col, weights)
    shard = out.columns[-1]
    out.hint("rebalance", F.col(f"`{shard}`")).write.mode("overwrite").partitionBy(shard).parquet(path)
