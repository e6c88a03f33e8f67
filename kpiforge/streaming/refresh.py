"""Periodic refresh of the KPI tables with Structured Streaming.

New order files land in an inbox folder.  A file stream picks them up
(``trigger(processingTime="5 minutes")`` in production, ``availableNow``
in tests) and ``foreachBatch`` does, per micro-batch:

1. append the batch's raw rows to the raw store under ``epoch=<id>``
   (overwrite of that one folder, so a replayed epoch is idempotent);
2. rebuild clean orders from the whole store and write them once to the
   shared checkpoint folder (lineage cut, deleted when the tables are there);
3. write a day-grain rollup of them, which six views are sums of, then every
   view table to a new folder, and switch one pointer to it, so readers always
   see tables of one age.

The category median and keep-first de-duplication depend on all rows, so
the tables are rebuilt from the store rather than patched; the results
are therefore identical to the batch path.  The stream's own progress
lives in its checkpoint folder, so a restarted job resumes after the last
committed batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kpiforge.operators.partitioning import parts_by_size
from kpiforge.plans.rollup import order_rollup
from kpiforge.plans.tables import OrderTables
from kpiforge.plans.views import build_views
from kpiforge.schema import ORDER_COLUMNS, ORDERS_SCHEMA
from kpiforge.session import ensure_checkpoint_dir, materialize, scratch_path, scratch_scope
from kpiforge.sinks.versions import delete_folder, published, read_pointer, replace_pointer, write_tables


def refresh_tables(spark: SparkSession, store: str, out: str, as_of=None, epoch: int | None = None) -> dict[str, str]:
    """Rebuild clean orders and all view tables from the raw store and publish them at once.

    The tables go to a new folder, then one pointer is switched
    (``sinks.versions``); the folder published before stays for readers
    that are still at it, older ones are deleted, and so is the scratch that
    the rebuild wrote.
    """
    out = out.rstrip("/")
    spark.catalog.refreshByPath(store)
    before = read_pointer(spark, f"{out}/current.json") or {}
    folder = f"{out}/v-{uuid.uuid4().hex}"
    with scratch_scope(spark):
        t = OrderTables(spark.read.parquet(store).select(*ORDER_COLUMNS), as_of=as_of, materialized=True)
        rollup = materialize(order_rollup(t.clean), "rollup")
        paths = write_tables(build_views(t.raw, t.clean, as_of, t.deduped, rollup) | {"issue_log": t.issues}, folder)
    replace_pointer(spark, f"{out}/current.json", {"epoch": epoch, "folder": folder, "before": before.get("folder"), "tables": paths})
    if before.get("before"):
        delete_folder(spark, before["before"])
    return paths


def start_refresh(
    spark: SparkSession,
    inbox: str,
    store: str,
    out: str,
    checkpoint: str,
    as_of=None,
    processing_time: str | None = "5 minutes",
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the refresh stream over Parquet order files in ``inbox``."""
    reader = spark.readStream.schema(ORDERS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(inbox)

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        # the check stops at the first row, so the micro-batch is read once and kept nowhere
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch_id}")
        refresh_tables(batch.sparkSession, store, out, as_of, epoch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def refresh_once(
    spark: SparkSession, raw: DataFrame, as_of=None, files: int = 4, files_per_batch: int = 2
) -> DataFrame:
    """Drop ``raw`` into a fresh inbox in ``files`` lots, ``files_per_batch``
    lots a micro-batch, drain the stream in ``availableNow`` mode and return
    the refreshed category performance table; a lot is as many files as its
    size asks for, so all cores write them."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "refresh")
    parts = parts_by_size(raw, files)
    raw.repartition(parts).write.parquet(f"{base}/inbox")
    query = start_refresh(
        spark,
        f"{base}/inbox",
        f"{base}/store",
        f"{base}/out",
        f"{base}/stream_checkpoint",
        as_of=as_of,
        available_now=True,
        max_files_per_trigger=files_per_batch * (parts // files),
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(published(spark, f"{base}/out")["vw_category_performance"])
