"""Incremental refresh: tables equal to a rebuild from all rows, whatever order they arrive in.

A micro-batch of arriving order files changes a state kept in the shared
folder; the work of a batch follows its own rows, not the history.

* **Kept copies can be taken back.**  ``ids`` is a keyed store (buckets and
  Bloom filters, ``keyed_store``) with the rows that can still be an id's
  kept copy: the first one in the batch job's order with revenue, and the
  first one without, where they agree on everything before revenue (which
  of the two comes first depends on the category's median).  An arriving
  copy that comes before the kept one replaces it: the old row counts -1
  and the new one +1 in everything below (a signed multiset of rows).
  Ids with two such rows are listed in ``contested`` and settled anew
  whenever the medians move.
* **Medians follow the data.**  ``value_histogram`` keeps a mergeable
  histogram of all raw values; missing revenue is filled only when tables
  are published, since cells count rows without revenue apart from known
  sums.  A given median table can be used instead.
* ``rollup``: signed sums per day, category, region, payment, status, and
  whether revenue is missing.  ``customers``: a keyed store with the number
  of rows of every (region, customer), looked up for the batch's pairs only;
  ``people`` has the distinct customers per region.  ``top``: a reserve of
  the best Completed orders with a mark of how far down it is known to be
  whole; if it runs low it is refilled from the store.  ``ahead``: rows dated
  after the reporting day, which become due as it moves.  ``counts``.

A batch writes new folders only and then replaces one JSON pointer
atomically (``sinks.versions``); it names the state's folders and the
published tables.  A failed or replayed batch therefore changes nothing
until its pointer is in place, and readers always see tables of one age.
Runs are merged tier by tier, MERGE_RUNS at a time, so the number of files
stays logarithmic; folders that neither the current nor the previous
pointer names are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kpiforge.functions.expressions import as_of_literal
from kpiforge.operators import cleaning, metrics
from kpiforge.operators.joins import broadcast_if, fits_broadcast
from kpiforge.operators.partitioning import parts_by_rows, parts_by_size, shuffles_into
from kpiforge.plans.rollup import ROLLUP_KEYS, add_up, rollup_views
from kpiforge.plans.views import quality_rows
from kpiforge.schema import CLEAN_REVENUE_TYPE, COMPLETED, DEDUP_ORDER, ORDER_COLUMNS, ORDERS_SCHEMA, TOP_ORDERS_LIMIT
from kpiforge.session import ensure_checkpoint_dir, scratch_path, shuffles_dropped
from kpiforge.sinks.versions import at_once, delete_folder, published, read_pointer, replace_pointer, write_tables
from kpiforge.streaming import value_histogram
from kpiforge.streaming.keyed_store import KeyedStore

MERGE_RUNS = 16
# Rows a slot of the top reserve holds; it is refilled when fewer than the published ones are left.
RESERVE = 64

COUNTS = ["raw_rows", "missing", "negative_raw", "accepted", "known_ids"]
BEFORE_REVENUE = DEDUP_ORDER[: DEDUP_ORDER.index("revenue")]
CELL_KEYS = [*ROLLUP_KEYS, "no_revenue"]
CELL_SUMS = ["rows", "orders", "priced", "united", "units", "revenue"]
PEOPLE_SCHEMA = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("no_revenue", T.BooleanType()),
        T.StructField("category", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def _pointer(out: str) -> str:
    return f"{out.rstrip('/')}/current.json"


def _ids(spark: SparkSession, out: str) -> KeyedStore:
    return KeyedStore(spark, f"{out}/state", "ids", ["order_id"], ORDERS_SCHEMA, MERGE_RUNS)


def _customers(spark: SparkSession, out: str) -> KeyedStore:
    return KeyedStore(spark, f"{out}/state", "customers", ["region", "customer_id"], PEOPLE_SCHEMA, MERGE_RUNS)


# --- which copy of an id is kept ---------------------------------------------------


def _no_revenue() -> Column:
    return F.col("revenue").isNull()


def best_copies(rows: DataFrame) -> DataFrame:
    """The first row of each id with revenue, and the first one without.

    ``rows`` may carry ``_fresh``; of equal rows one that is not fresh is taken.
    """
    last = [F.col("_fresh").asc()] if "_fresh" in rows.columns else []
    best = Window.partitionBy("order_id", _no_revenue()).orderBy(*cleaning.dedup_order(), *last)
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def possible_copies(rows: DataFrame) -> DataFrame:
    """The rows that can be the kept copy of their id under some median: one, or two that differ in having revenue.

    The same whether ``rows`` are all rows or the ``best_copies`` of some of them and all others.
    """
    first = Window.partitionBy("order_id").orderBy(*[F.col(c).asc_nulls_last() for c in BEFORE_REVENUE])
    return best_copies(rows).withColumn("_n", F.rank().over(first)).where("_n = 1").drop("_n")


def with_median(rows: DataFrame, medians: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the median of their category as ``_median`` (null without one, or without a category)."""
    med = medians.select(F.col("category").alias("_mcat"), F.col("median_revenue").alias("_median"))
    return rows.join(broadcast_if(med, small), F.col("category") == F.col("_mcat"), "left").drop("_mcat")


def settled(copies: DataFrame, medians: DataFrame, small: bool) -> DataFrame:
    """The kept copy of each id, with its revenue as it arrived."""
    filled = with_median(copies, medians, small).withColumn("_raw", F.col("revenue"))
    filled = filled.withColumn("revenue", F.coalesce(F.col("revenue").cast(CLEAN_REVENUE_TYPE), F.col("_median")))
    kept = cleaning.dedup_orders(filled)
    return kept.select(*[F.col("_raw").alias(c) if c == "revenue" else F.col(c) for c in ORDER_COLUMNS])


def signed_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the multiset ``new - old`` with their multiplicity ``sign``."""
    both = new.select(*ORDER_COLUMNS, F.lit(1).alias("sign")).unionByName(old.select(*ORDER_COLUMNS, F.lit(-1).alias("sign")))
    return both.groupBy(*ORDER_COLUMNS).agg(F.sum("sign").alias("sign")).where("sign <> 0")


# --- sums of signed rows ------------------------------------------------------------


def signed_cells(change: DataFrame) -> DataFrame:
    """CELL_SUMS per CELL_KEYS of the signed rows that are not negative."""
    sign, kept = F.col("sign"), change.where(cleaning.is_kept())
    some = lambda c: sign * F.col(c).isNotNull().cast("long")
    return kept.groupBy(
        F.to_date("order_date").alias("sale_date"), "category", "region", "payment_method", "status", _no_revenue().alias("no_revenue")
    ).agg(
        F.sum("sign").alias("rows"),
        F.sum(some("order_id")).alias("orders"),
        F.sum(some("revenue")).alias("priced"),
        F.sum(some("quantity")).alias("united"),
        F.sum(sign * F.coalesce("quantity", F.lit(0))).alias("units"),
        F.sum(sign * F.coalesce(F.col("revenue").cast(CLEAN_REVENUE_TYPE), F.lit(0).cast(CLEAN_REVENUE_TYPE))).cast("decimal(28,4)").alias("revenue"),
    )


def _add_cells(cells: DataFrame) -> DataFrame:
    sums = [(F.sum(c).cast("decimal(28,4)") if c == "revenue" else F.sum(c)).alias(c) for c in CELL_SUMS]
    return cells.groupBy(*CELL_KEYS).agg(*sums).where("rows <> 0")


def filled_rollup(cells: DataFrame, medians: DataFrame, small: bool) -> DataFrame:
    """The rollup of clean orders: cells without revenue get their median, or go if it is negative."""
    filled = with_median(cells, medians, small).where(~F.col("no_revenue") | F.col("_median").isNull() | (F.col("_median") >= 0))
    filled = filled.withColumn("priced", F.when(F.col("no_revenue") & F.col("_median").isNotNull(), F.col("rows")).otherwise(F.col("priced")))
    amount = F.when(F.col("no_revenue"), F.col("rows") * F.col("_median")).otherwise(F.col("revenue")).cast("decimal(28,4)")
    filled = filled.withColumn("revenue", F.when(F.col("priced") > 0, amount))
    return add_up(filled.withColumn("units", F.when(F.col("united") > 0, F.col("units"))), *ROLLUP_KEYS)


def _counts_of(batch: DataFrame, change: DataFrame) -> DataFrame:
    """One row of COUNTS: of the batch's rows, and of the change in kept copies."""
    raw = batch.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(_no_revenue()).alias("missing"), F.count_if(F.col("revenue") < 0).alias("negative_raw")
    )
    kept = change.agg(F.sum("sign").alias("accepted"), F.sum(F.when(F.col("order_id").isNotNull(), F.col("sign"))).alias("known_ids"))
    zero = F.lit(0).cast("long")
    parts = [df.select(*[F.col(c) if c in df.columns else zero.alias(c) for c in COUNTS]) for df in (raw, kept)]
    return _sum_counts(parts[0].unionByName(parts[1]))


def _sum_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])


def _ahead_of(batch: DataFrame, change: DataFrame, as_of) -> DataFrame:
    """Rows dated after the start of the reporting day: raw ones, and the change in kept copies that are not negative."""
    today = F.to_date(as_of_literal(as_of)).cast("timestamp_ntz")
    late = F.col("order_date") > today
    raw = batch.where(late).select("order_date", F.lit("raw").alias("kind"), F.lit(None).cast("string").alias("category"), F.lit(1).alias("n"))
    kept = change.where(late & cleaning.is_kept()).select(
        "order_date",
        F.when(_no_revenue(), "missing").otherwise("known").alias("kind"),
        F.when(_no_revenue(), F.col("category")).alias("category"),
        F.col("sign").alias("n"),
    )
    return raw.unionByName(kept)


def _add_ahead(ahead: DataFrame, as_of) -> DataFrame:
    today = F.to_date(as_of_literal(as_of)).cast("timestamp_ntz")
    sums = ahead.where(F.col("order_date") > today).groupBy("order_date", "kind", "category").agg(F.sum("n").cast("long").alias("n"))
    return sums.where("n <> 0")


def table_counts(counts: DataFrame, rollup: DataFrame, ahead: DataFrame, medians: DataFrame, small: bool, as_of) -> DataFrame:
    """All counts of the issue log and the quality view, as one row."""
    kept = (F.col("kind") == "known") | ((F.col("kind") == "missing") & (F.col("_median").isNull() | (F.col("_median") >= 0)))
    dated = with_median(ahead, medians, small).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "raw", F.col("n"))), F.lit(0)).alias("future_raw"),
        F.coalesce(F.sum(F.when(kept & (F.col("order_date") > as_of_literal(as_of)), F.col("n"))), F.lit(0)).alias("future"),
    )
    clean = rollup.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("clean_rows"))
    one = counts
    for part in (dated, clean):
        one = one.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return one.withColumn("negative", F.col("accepted") - F.col("clean_rows"))


# --- distinct customers ---------------------------------------------------------------


def _pairs_of(change: DataFrame) -> DataFrame:
    """Signed rows per (region, customer), those without revenue by category."""
    return (
        change.where(cleaning.is_kept() & F.col("customer_id").isNotNull())
        .groupBy("region", "customer_id", _no_revenue().alias("no_revenue"), F.when(_no_revenue(), F.col("category")).alias("category"))
        .agg(F.sum("sign").alias("n"))
        .where("n <> 0")
    )


def _presence(pairs: DataFrame) -> DataFrame:
    """Per (region, customer): whether any row is left."""
    return pairs.groupBy("region", "customer_id").agg((F.sum("n") > 0).cast("long").alias("here"))


def customers_per_region(store: KeyedStore, runs: list, people: DataFrame, medians: DataFrame, small: bool) -> DataFrame:
    """``(region, unique_customers)`` of clean orders.

    ``people`` has them if no median is negative.  Rows that a negative
    median drops may be the only ones of a customer; then all pairs are read.
    """
    if medians.where(F.col("median_revenue") < 0).isEmpty():
        return people
    pairs = with_median(store.everything(runs), medians, small)
    pairs = pairs.where(~F.col("no_revenue") | F.col("_median").isNull() | (F.col("_median") >= 0)).drop("_median")
    return _presence(pairs).groupBy("region").agg(F.sum("here").alias("unique_customers"))


# --- top orders -------------------------------------------------------------------------


def _slot() -> Column:
    """Rows that rank among each other whatever the medians are."""
    return F.when(_no_revenue(), F.concat(F.lit("="), F.coalesce("category", F.lit("")), F.col("category").isNull().cast("string"))).otherwise("known")


def _top_order() -> list[Column]:
    return [F.col("revenue").desc_nulls_first()] + [F.col(c).asc_nulls_last() for c in ["order_id"] + [c for c in DEDUP_ORDER if c != "revenue"]]


def best_of_slots(rows: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("slot").orderBy(*_top_order())
    rows = rows.where((F.col("status") == COMPLETED) & cleaning.is_kept()).select(*ORDER_COLUMNS, _slot().alias("slot"))
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n).drop("_n")


def new_reserve(old: DataFrame | None, change: DataFrame) -> DataFrame:
    """The reserve after a change.

    A row with ``mark`` repeats the last row of its slot down to which the
    reserve was once whole; what comes after a mark is not known and left
    out.  A slot without a mark holds all its rows.
    """
    plus = best_of_slots(change.where("sign > 0"), RESERVE + 1).withColumn("mark", F.lit(False))
    if old is not None:
        gone = change.where("sign < 0").select(F.col("order_id").alias("_gone"))
        still = old.where(~F.col("mark")).join(gone, F.col("order_id").eqNullSafe(F.col("_gone")), "left_anti")
        plus = plus.unionByName(still).unionByName(old.where("mark"))
    by_rank = Window.partitionBy("slot").orderBy(*_top_order(), F.col("mark"))
    past = F.max(F.col("mark").cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, -1))
    rows = plus.withColumn("_past", past).where(F.coalesce("_past", F.lit(0)) == 0).drop("_past")
    one = (~F.col("mark")).cast("int")
    rows = rows.withColumn("_n", F.sum(one).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_all", F.sum(one).over(Window.partitionBy("slot")))
    cut = F.col("_all") > RESERVE
    marks = F.array(F.lit(False), F.lit(True))  # the last row of a cut slot becomes its mark as well
    kept = rows.where((~F.col("mark") & (F.col("_n") <= RESERVE)) | (F.col("mark") & ~cut))
    both = F.when(cut & (F.col("_n") == RESERVE) & ~F.col("mark"), marks).otherwise(F.array("mark"))
    return kept.withColumn("mark", F.explode(both)).drop("_n", "_all")


def is_low(reserve: DataFrame) -> bool:
    """Whether a slot that does not hold all its rows has fewer than are published."""
    slots = reserve.groupBy("slot").agg(F.count_if(~F.col("mark")).alias("n"), F.max("mark").alias("cut"))
    return not slots.where(F.col("cut") & (F.col("n") < TOP_ORDERS_LIMIT)).isEmpty()


# --- the batch -----------------------------------------------------------------------


def _merged_paths(spark: SparkSession, runs: list, kind: str, out: str, merge) -> list:
    """Merge plain runs, MERGE_RUNS of one tier into one of the next."""
    tier = 0
    while any(t >= tier for t, _ in runs):
        same = [r for r in runs if r[0] == tier]
        if len(same) >= MERGE_RUNS:
            path = f"{out}/state/{kind}-{uuid.uuid4().hex}"
            merge(same, path)
            runs = [r for r in runs if r[0] != tier] + [[tier + 1, path]]
        tier += 1
    return runs


def _merge_sketches(df: DataFrame) -> DataFrame:
    return df.groupBy("region").agg(F.hll_union_agg("sketch").alias("sketch"))


def apply_batch(
    batch: DataFrame, epoch: int, out: str, medians_path: str | None = None, as_of=None, approx_customers: bool = False
) -> dict:
    """Add one batch of raw orders to the state under ``out`` and publish the tables.

    Medians come from all rows that have arrived, or from the table at
    ``medians_path`` (read anew for every batch).  Returns the new pointer.
    A batch whose epoch is already in the state (a replay after its commit)
    changes nothing.  Shuffles are dealt by the rows of the batch and of the
    store, which a look-up may have to read; a stream's batches have a
    session of their own, so nothing else sees that setting.
    """
    spark, out = batch.sparkSession, out.rstrip("/")
    before = read_pointer(spark, _pointer(out)) or {"epoch": -1, "ids": [], "customers": [], "values": [], "state": None, "schemas": {}, "folders": []}
    if before["epoch"] >= epoch:
        return before
    if before["state"] and not medians_path and "coarse" not in before["schemas"]:
        raise ValueError("this state was filled from a given median table and knows no medians of its own: give the table, or start a new state")
    batch = batch.select(*ORDER_COLUMNS)  # its files are read again rather than kept a second time
    with shuffles_dropped(spark), shuffles_into(spark, parts_by_rows(batch.count() + sum(r["rows"] for r in before["ids"]))):
        return _apply_new(batch, before, epoch, out, medians_path, as_of, approx_customers)


def _apply_new(
    batch: DataFrame, before: dict, epoch: int, out: str, medians_path: str | None, as_of, approx_customers: bool
) -> dict:
    """``apply_batch`` for a batch that the state ``before`` does not hold yet.

    A working table goes as soon as all that is read from it is written.
    """
    spark = batch.sparkSession
    folder = f"{out}/state/{epoch}-{uuid.uuid4().hex}"
    old = {k: spark.read.schema(T.StructType.fromJson(json.loads(v))).parquet(f"{before['state']}/{k}") for k, v in before["schemas"].items()}
    schemas: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        if name not in SCRATCH:
            schemas[name] = df.schema.json()
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def gone(*names: str) -> None:
        for name in names:
            delete_folder(spark, f"{folder}/{name}")

    def plus_old(name: str, df: DataFrame) -> DataFrame:
        return df.unionByName(old[name]) if name in old else df

    def medians_now() -> tuple[DataFrame, list]:
        if medians_path:
            spark.catalog.refreshByPath(medians_path)  # a newly published table
            return put("medians", spark.read.parquet(medians_path).select("category", "median_revenue")), before["values"]
        path = f"{out}/state/values-{uuid.uuid4().hex}"
        value_histogram.write_fine(value_histogram.batch_histogram(batch), path)
        runs = before["values"] + [[0, path]]
        fresh = value_histogram.read_fine(spark, [[0, path]])
        coarse = put("coarse", value_histogram.coarse_counts([fresh, *([old["coarse"]] if "coarse" in old else [])]))
        return put("medians", value_histogram.medians(coarse, value_histogram.read_fine(spark, runs))), runs

    def copies_now() -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
        """The batch's ids: rows of the store, and rows that can be kept from now on; contested rows of other ids; rows that arrived."""
        arrived = put("arrived", ids.hashed(best_copies(batch)))
        keys = arrived.select("order_id", "_h").distinct()
        known = put("known", ids.look_up(before["ids"], keys))
        rows = arrived.drop("_h").withColumn("_fresh", F.lit(True)).unionByName(known.withColumn("_fresh", F.lit(False)))
        of_id = Window.partitionBy("order_id")
        # four rows of an id at most: all windows share one exchange by id
        rows = possible_copies(rows.repartition("order_id")).withColumn("_two", F.count(F.lit(1)).over(of_id) > 1).withColumn("_fresh", F.max("_fresh").over(of_id))
        rows = put("copies", rows)
        waiting = None
        if "contested" in old:
            touched = keys.select(F.col("order_id").alias("_k"))
            waiting = put("waiting", old["contested"].join(touched, F.col("order_id").eqNullSafe(F.col("_k")), "left_anti"))
        count = arrived.count()
        gone("arrived")
        return known, rows, waiting, count

    def contested_now() -> DataFrame:
        contested = rows.where("_two").select(*ORDER_COLUMNS)
        return put("contested", contested if waiting is None else contested.unionByName(waiting))

    def ids_now() -> list:
        return ids.merged(before["ids"] + [ids.write(rows.where("_fresh").select(*ORDER_COLUMNS), epoch, count=arrived)])

    def cells_now() -> DataFrame:
        cells = put("cells", _add_cells(plus_old("cells", signed_cells(change))))
        return put("rollup", filled_rollup(cells, medians, small))

    def counts_now() -> list[DataFrame]:
        of_batch = put("batch_counts", _counts_of(batch, change))
        refused = of_batch.select(
            F.lit(epoch).cast("long").alias("epoch"), F.col("raw_rows"), (F.col("raw_rows") - F.col("accepted")).alias("refused_rows")
        )
        return at_once(
            spark,
            lambda: put("counts", _sum_counts(plus_old("counts", of_batch))),
            lambda: put("refused", plus_old("refused", refused).coalesce(1)),
        )

    def ahead_now() -> DataFrame:
        return put("ahead", _add_ahead(plus_old("ahead", _ahead_of(batch, change, as_of)), as_of))

    def top_now() -> tuple[DataFrame, bool]:
        top = put("top", new_reserve(old.get("top"), change))
        return top, is_low(top)

    def sketches_now() -> tuple[DataFrame, list]:
        path = f"{out}/state/customers-{uuid.uuid4().hex}"
        sketches = change.where("sign > 0").where(cleaning.is_kept()).groupBy("region").agg(F.hll_sketch_agg("customer_id").alias("sketch"))
        sketches.write.parquet(path)
        read = lambda runs: spark.read.parquet(*[p for _, p in runs])
        runs = _merged_paths(
            spark, before["customers"] + [[0, path]], "customers", out, lambda part, to: _merge_sketches(read(part)).write.parquet(to)
        )
        return _merge_sketches(read(runs)).select("region", F.hll_sketch_estimate("sketch").alias("unique_customers")), runs

    def people_now() -> tuple[DataFrame, list]:
        store = _customers(spark, out)
        pairs = put("pairs", store.hashed(_pairs_of(change)))
        seen = put("seen", store.look_up(before["customers"], pairs.select("region", "customer_id", "_h").distinct()))
        total = seen.unionByName(pairs.drop("_h")).groupBy("region", "customer_id", "no_revenue", "category").agg(F.sum("n").alias("n"))
        step = _presence(total).unionByName(_presence(seen).withColumn("here", -F.col("here")))
        step = step.groupBy("region").agg(F.sum("here").alias("unique_customers"))
        runs, people = at_once(
            spark,
            lambda: store.merged(before["customers"] + [store.write(total, epoch, count=pairs.count())], drop=F.col("n") == 0),
            lambda: put("people", plus_old("people", step).groupBy("region").agg(F.sum("unique_customers").alias("unique_customers"))),
        )
        gone("pairs", "seen")
        return customers_per_region(store, runs, people, medians, small), runs

    ids = _ids(spark, out)
    medians, values = medians_now()
    known, rows, waiting, arrived = copies_now()
    small = fits_broadcast(medians)
    # the change in kept copies: contested ids of earlier batches may be settled another way
    then, now = known, rows.select(*ORDER_COLUMNS)
    if waiting is not None:
        then, now = then.unionByName(waiting), now.unionByName(waiting)
    change = put("change", signed_change(settled(then, old.get("medians", medians), small), settled(now, medians, small)))
    gone("known")
    id_runs, _ = at_once(spark, ids_now, contested_now)
    gone("copies", "waiting")
    (people, person_runs), clean_rollup, (counts, refused), ahead, (top, low) = at_once(
        spark, sketches_now if approx_customers else people_now, cells_now, counts_now, ahead_now, top_now
    )
    gone("change", "batch_counts")
    if low:
        everything = settled(ids.everything(id_runs), medians, small)
        top = put("refilled", new_reserve(None, everything.withColumn("sign", F.lit(1))))
        delete_folder(spark, f"{folder}/top")
        top = put("top", top)
    # regions whose customers are all unknown have none
    regions = clean_rollup.select("region").distinct().withColumn("unique_customers", F.lit(0).cast("long"))
    people = regions.unionByName(people).groupBy("region").agg(F.sum("unique_customers").alias("unique_customers"))
    filled_top = with_median(top.where(~F.col("mark")), medians, small)
    filled_top = filled_top.withColumn("revenue", F.coalesce(F.col("revenue").cast(CLEAN_REVENUE_TYPE), F.col("_median"))).select(*ORDER_COLUMNS)
    tables = rollup_views(clean_rollup, people, cleaning.drop_negative(filled_top), as_of)
    one = table_counts(counts, clean_rollup, ahead, medians, small, as_of)
    tables |= {
        "vw_data_quality": quality_rows(
            one, F.col("missing"), F.col("raw_rows") - F.col("known_ids"), F.col("future_raw"), F.col("negative_raw"), as_of
        ),
        "issue_log": cleaning.issue_rows(one.withColumn("dedup_rows", F.col("accepted"))),
        "refused_orders": refused.orderBy("epoch"),
        "category_median": medians,
    }

    def merge_values(runs: list, to: str) -> None:
        whole = value_histogram.read_fine(spark, runs).groupBy("category", "bucket", "value").agg(F.sum("n").alias("n"))
        value_histogram.write_fine(whole.repartitionByRange("bucket", "category"), to)

    paths, values = at_once(
        spark, lambda: write_tables(tables, f"{folder}/tables"), lambda: _merged_paths(spark, values, "values", out, merge_values)
    )
    now = {
        "epoch": epoch, "ids": id_runs, "customers": person_runs, "values": values, "state": folder, "schemas": schemas, "tables": paths,
    }
    runs = [r["path"] if isinstance(r, dict) else r[1] for r in id_runs + person_runs + values]
    now["folders"] = sorted({folder, *runs})
    replace_pointer(spark, _pointer(out), now | {"before": before["folders"]})
    _clear(spark, before, now, folder)
    return now


SCRATCH = ["arrived", "known", "copies", "waiting", "change", "batch_counts", "rollup", "refilled", "pairs", "seen"]


def _clear(spark: SparkSession, before: dict, now: dict, folder: str) -> None:
    """Delete what neither the new pointer nor the one before it names."""
    for name in SCRATCH:
        delete_folder(spark, f"{folder}/{name}")
    for path in set(before.get("before", [])) - {*now["folders"], *before["folders"]}:
        delete_folder(spark, path)


def start_incremental_refresh(
    spark: SparkSession,
    inbox: str,
    out: str,
    checkpoint: str,
    medians_path: str | None = None,
    as_of=None,
    processing_time: str | None = "5 minutes",
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
    approx_customers: bool = False,
    clear_inbox: bool = False,
) -> StreamingQuery:
    """Start the incremental refresh over Parquet order files in ``inbox``.

    ``approx_customers`` counts customers by sketches that only grow: rows
    taken back stay in them.  ``clear_inbox`` deletes files whose batch is
    in the state (a replay asks for those of the last batch only).
    """
    reader = spark.readStream.schema(ORDERS_SCHEMA)
    if clear_inbox:
        reader = reader.option("cleanSource", "delete")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        apply_batch(batch, epoch_id, out, medians_path, as_of, approx_customers)

    writer = reader.parquet(inbox).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def incremental_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables that are published under ``out`` now."""
    return {name: spark.read.parquet(path) for name, path in published(spark, out).items()}


def refresh_incremental_once(
    spark: SparkSession,
    arrivals: list[DataFrame],
    medians: DataFrame | None = None,
    files: int = 2,
    files_per_batch: int = 1,
    as_of=None,
) -> dict[str, DataFrame]:
    """Drop ``arrivals`` one after the other into a fresh inbox in ``files``
    lots each, ``files_per_batch`` lots a micro-batch, drain the stream and
    return the tables; a lot is as many files as its size asks for, so no task
    writes or reads more than a file's rows.  ``medians``, if given, are
    published and used instead of the stream's own."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "incremental")
    if medians is not None:
        medians.write.parquet(f"{base}/medians")
    for raw in arrivals:
        parts = parts_by_size(raw, files)
        with shuffles_dropped(spark), shuffles_into(spark, parts):  # what ``raw`` is joined from as well
            raw.write.parquet(f"{base}/raw")  # so the shuffles of its joins are gone when it is dealt out
            spark.read.schema(raw.schema).parquet(f"{base}/raw").repartition(parts).write.mode("append").parquet(f"{base}/inbox")
        delete_folder(spark, f"{base}/raw")
        query = start_incremental_refresh(
            spark, f"{base}/inbox", f"{base}/out", f"{base}/stream_checkpoint", f"{base}/medians" if medians is not None else None,
            as_of=as_of, available_now=True, max_files_per_trigger=files_per_batch * (parts // files),
            clear_inbox=True,
        )
        query.awaitTermination()
        if query.exception() is not None:
            raise RuntimeError(str(query.exception()))
    delete_folder(spark, f"{base}/inbox")
    return incremental_tables(spark, f"{base}/out")


def keep_first_arrivals(raw: DataFrame, medians: DataFrame) -> list[DataFrame]:
    """All raw rows as two arrivals: the copy of each id that the batch job keeps, then all repeats."""
    med = medians.select(F.col("category").alias("_cat"), F.col("median_revenue").alias("_med"))
    filled = F.coalesce(F.col("revenue").cast(CLEAN_REVENUE_TYPE), F.col("_med"))
    order = [(filled if c == "revenue" else F.col(c)).asc_nulls_last() for c in DEDUP_ORDER]
    rows = raw.join(med, F.col("category") == F.col("_cat"), "left").withColumn(
        "_n", F.row_number().over(Window.partitionBy("order_id").orderBy(*order))
    )
    return [rows.where("_n = 1").select(*raw.columns), rows.where("_n > 1").select(*raw.columns)]
