"""Exact per-group median that never gathers a large group into one task.

Spark's ``median`` merges every distinct value of a group in one task,
which does not hold when one group carries a third of a huge table.  Here
the median is found by distributed selection over a value histogram:

1. ``hist``: count per (group, value), a partially aggregated group-by
   hashed on both columns, so a hot group spreads over all tasks and
   repeated values collapse to one row.  Per group: ``n`` values and
   ``ndv`` distinct values; the median is the mean of the values at
   0-based ranks ``(n - 1) div 2`` and ``n div 2``.
2. While a group's candidate value window ``[lo, hi)`` holds more than
   ``max_group_rows`` distinct values, a mergeable quantile sketch
   (``percentile_approx``, bounded memory) over the window's distinct
   values gives ``grid`` cut points.  Exact counts per bucket (one partial
   aggregate) locate the buckets holding the two target ranks; they become
   the new window.  Each round divides the distinct values by about
   ``grid / 2``; the counts are exact, the sketch only steers.
3. When no group needed refinement, Spark's exact weighted
   ``percentile(value, 0.5, count)`` over the histogram finishes the job
   (its per-group map is bounded by ``max_group_rows``).  Otherwise the
   at most ``max_group_rows`` distinct values left per group are ranked
   with a running sum of their counts (a window function) and the two
   middle values are averaged.

Per-group state (one row per group) is joined back after a size check
and written to the shared checkpoint folder after each round, so the
lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.operators.joins import size_checked_broadcast
from kpiforge.session import materialize

MAX_GROUP_ROWS = 1_000_000
GRID = 200
MAX_ROUNDS = 64


def _nullsafe(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, left["_k"].eqNullSafe(right["_sk"]))


def _in_window() -> Column:
    lo_ok = F.col("lo").isNull() | (F.col("_v") >= F.col("lo"))
    hi_ok = F.col("hi").isNull() | (F.col("_v") < F.col("hi"))
    return lo_ok & hi_ok


def _covers(rank: str) -> Column:
    """Bucket/value row whose rank range ``[first, cum)`` contains ``rank``."""
    return (F.col("_first") <= F.col(rank)) & (F.col(rank) < F.col("_cum"))


def group_median(
    df: DataFrame,
    key: str,
    value: str,
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
    grid: int = GRID,
    accuracy: int | None = None,
) -> DataFrame:
    """``DataFrame[key, median double]``: exact median of ``value`` per ``key``.

    Missing values are ignored; a group with no value gets NULL.  A NULL key
    is a group of its own, as in SQL ``GROUP BY``.
    """
    accuracy = accuracy or 20 * grid
    vals = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    # The one pass over the rows.  Written (12 to 20 bytes per distinct value of
    # a group): the exact distinct counts pick the method, and every later step
    # reads this table.
    hist = materialize(vals.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")), "median_hist")
    values = hist.where(F.col("_v").isNotNull())
    state = (
        hist.groupBy("_k")
        .agg(
            F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)).alias("n"),
            F.count("_v").alias("ndv"),
        )
        .select(
            F.col("_k").alias("_sk"),
            "n",
            F.expr("(n - 1) div 2").alias("r1"),
            F.expr("n div 2").alias("r2"),
            F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"),
            F.lit(0).cast("long").alias("below"),
            "ndv",
        )
    )
    state = materialize(state, "median_state")

    quantiles = [i / grid for i in range(grid + 1)]
    m = grid + 1
    rounds = 0
    for rounds in range(MAX_ROUNDS + 1):
        wide = state.where(F.col("ndv") > max_group_rows)
        if wide.isEmpty():
            break
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"a group still spans more than {max_group_rows} distinct values after {MAX_ROUNDS} rounds")
        wide_b = size_checked_broadcast(wide, persist=False)
        grids = (
            _nullsafe(values, wide_b)
            .where(_in_window())
            .groupBy("_sk")
            .agg(F.percentile_approx("_v", quantiles, accuracy).alias("g"))
        )
        gw = grids.withColumnRenamed("_sk", "_gk")
        # written, not just persisted: the sketch result may depend on merge
        # order, and both uses below must see the same grid even if an
        # executor holding a cached block is lost
        gw = materialize(wide.join(gw, wide["_sk"].eqNullSafe(gw["_gk"])).drop("_gk"), "median_grid")
        gw = size_checked_broadcast(gw, persist=False)
        # bucket j holds values in [g[j], g[j+1]) with g[0] = lo, g[m+1] = hi
        buckets = (
            _nullsafe(values, gw)
            .where(_in_window())
            .withColumn("_j", F.size(F.filter("g", lambda x: x <= F.col("_v"))))
            .groupBy("_sk", "_j")
            .agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_bd"))
        )
        upto = Window.partitionBy("_sk").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
        located = (
            buckets.withColumn("_cum_rows", F.sum("_bc").over(upto))
            .withColumn("_cum_vals", F.sum("_bd").over(upto))
            .withColumnRenamed("_sk", "_bk")
        )
        located = located.join(gw, located["_bk"].eqNullSafe(gw["_sk"])).select(
            "_sk", "_j", "_bc", "_bd", "_cum_vals", "below", "r1", "r2", "lo", "hi", "g",
            (F.col("below") + F.col("_cum_rows") - F.col("_bc")).alias("_first"),
            (F.col("below") + F.col("_cum_rows")).alias("_cum"),
        )
        bucket_lo = F.when(F.col("_j") == 0, F.col("lo")).otherwise(F.element_at("g", F.col("_j")))
        bucket_hi = F.when(F.col("_j") == m, F.col("hi")).otherwise(
            F.element_at("g", F.col("_j") + 1)
        )
        moved = located.groupBy("_sk").agg(
            F.max(F.when(_covers("r1"), bucket_lo)).alias("lo"),
            F.max(F.when(_covers("r2"), bucket_hi)).alias("hi"),
            F.max(F.when(_covers("r1"), F.col("_first"))).alias("below"),
            (
                F.max(F.when(_covers("r2"), F.col("_cum_vals")))
                - F.max(F.when(_covers("r1"), F.col("_cum_vals") - F.col("_bd")))
            ).alias("ndv"),
        )
        moved_b = size_checked_broadcast(
            materialize(moved, "median_moved").withColumnRenamed("_sk", "_mk").withColumn("_moved", F.lit(True)), persist=False
        )
        joined = state.join(moved_b, state["_sk"].eqNullSafe(moved_b["_mk"]), "left")
        state = materialize(
            joined.select(
                "_sk", "n", "r1", "r2",
                *[
                    F.when(F.col("_moved"), moved_b[c]).otherwise(state[c]).alias(c)
                    for c in ["lo", "hi", "below", "ndv"]
                ],
            ),
            "median_state",
        )

    if rounds == 0:
        # every group has at most max_group_rows distinct values, so Spark's
        # exact weighted percentile over the histogram holds a bounded map
        # per group (partial maps per task, merged per group)
        return hist.groupBy("_k").agg(
            F.percentile("_v", F.lit(0.5), F.col("_c")).alias("median")
        ).withColumnRenamed("_k", key)

    final_b = size_checked_broadcast(state.where(F.col("n") > 0), persist=False)
    upto_v = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        _nullsafe(values, final_b)
        .where(_in_window())
        .withColumn("_cum", F.col("below") + F.sum("_c").over(upto_v))
        .withColumn("_first", F.col("_cum") - F.col("_c"))
        .where(_covers("r1") | _covers("r2"))
    )
    picked = ranked.groupBy("_k").agg(
        F.max(F.when(_covers("r1"), F.col("_v"))).alias("v1"),
        F.max(F.when(_covers("r2"), F.col("_v"))).alias("v2"),
    )
    groups = state.select("_sk")
    return groups.join(picked, groups["_sk"].eqNullSafe(picked["_k"]), "left").select(
        F.col("_sk").alias(key),
        ((F.col("v1") + F.col("v2")) / 2).alias("median"),
    )
