"""Category medians kept by a refresh: a mergeable histogram of all raw values.

``fine`` runs count the rows of every (category, value); they add up, so a
batch only writes its own.  ``coarse`` counts the rows of every (category,
bucket), where buckets are octaves of the value cut into 64 steps, in order
of the value: a few thousand rows for a category at most, rewritten with
each batch.  The two middle ranks of a category fall into one or two coarse
buckets, and only those are looked at in the fine runs (files are sorted by
bucket, and the bucket filter reaches the Parquet scan).  The medians are
exact: those of the batch job over all rows that have arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.operators.joins import broadcast_if, fits_broadcast
from kpiforge.schema import CLEAN_REVENUE_TYPE

STEP_BITS = 6
FINE = "category string, bucket int, value decimal(18,2), n long"
COARSE = "category string, bucket int, n long"
# Up to this many target buckets are pushed into the scan as a list.
PUSHED = 500


def bucket_of(value: Column) -> Column:
    """A bucket number that never falls as the value (of two decimals) rises."""
    cents = (F.abs(value) * 100).cast("long")
    bits = F.bin(cents)
    step = F.conv(F.rpad(F.substring(bits, 2, STEP_BITS), STEP_BITS, "0"), 2, 10).cast("int")
    size = F.length(bits) * (1 << STEP_BITS) + step
    return F.when(cents == 0, 0).when(value > 0, size).otherwise(-size).cast("int")


def batch_histogram(raw: DataFrame) -> DataFrame:
    """FINE rows of a batch: rows without a value count under a null value."""
    counts = raw.groupBy("category", F.col("revenue").cast("decimal(18,2)").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("category", bucket_of(F.col("value")).alias("bucket"), "value", "n")


def write_fine(histogram: DataFrame, path: str) -> None:
    """One run, each file sorted so that a bucket's rows lie together."""
    histogram.sortWithinPartitions("bucket", "category", "value").write.parquet(path)


def coarse_counts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("category", "bucket", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select("category", "bucket", "n"))
    return out.groupBy("category", "bucket").agg(F.sum("n").alias("n"))


def read_fine(spark: SparkSession, runs: list) -> DataFrame:
    return spark.read.schema(FINE).parquet(*[path for _, path in runs])


def medians(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """``(category, median_revenue)`` of every category that has rows; null without a value."""
    upto = Window.partitionBy("category").orderBy("bucket")
    whole = Window.partitionBy("category")
    ranked = (
        coarse.where(F.col("bucket").isNotNull())
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("all", F.sum("n").over(whole))
        .select(
            "category",
            "bucket",
            (F.col("upto") - F.col("n")).alias("below"),
            "upto",
            F.expr("(`all` - 1) div 2").alias("r1"),
            F.expr("`all` div 2").alias("r2"),
        )
    )
    holds = lambda r: (F.col("below") <= F.col(r)) & (F.col(r) < F.col("upto"))
    targets = ranked.where(holds("r1") | holds("r2")).select(F.col("category").alias("_c"), F.col("bucket").alias("_b"), "below", "r1", "r2")
    small = fits_broadcast(targets)
    if small:
        wanted = [r[0] for r in targets.select("_b").distinct().limit(PUSHED + 1).collect()]
        if len(wanted) <= PUSHED:
            fine = fine.where(F.col("bucket").isin(wanted))
    inside = fine.join(broadcast_if(targets, small), F.col("category").eqNullSafe(F.col("_c")) & (F.col("bucket") == F.col("_b")))
    values = inside.groupBy("category", "bucket", "value").agg(
        F.sum("n").alias("n"), F.first("below").alias("below"), F.first("r1").alias("r1"), F.first("r2").alias("r2")
    )
    in_bucket = Window.partitionBy("category", "bucket").orderBy("value")
    placed = values.withColumn("upto", F.col("below") + F.sum("n").over(in_bucket)).withColumn("below", F.col("upto") - F.col("n"))
    middle = placed.groupBy("category").agg(
        F.max(F.when(holds("r1"), F.col("value").cast("double"))).alias("v1"), F.max(F.when(holds("r2"), F.col("value").cast("double"))).alias("v2")
    )
    median = ((F.col("v1") + F.col("v2")) / 2).cast(CLEAN_REVENUE_TYPE)
    middle = middle.select(F.col("category").alias("_c"), median.alias("median_revenue"))
    known = coarse.select("category").distinct()
    return known.join(middle, F.col("category").eqNullSafe(F.col("_c")), "left").select("category", "median_revenue")
