"""Session settings and lineage cuts.

Cluster jobs get their settings from the cluster; ``build_session`` is for
tests, the bench and local runs.  Lineage is cut only by writing to the
shared folder named in ``spark.checkpoint.dir`` (never to a machine-local
temporary folder, never with ``localCheckpoint``), so a lost executor is
recovered by re-reading files every executor can see.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Spark's own removal of a query's shuffle files when the query ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "kpiforge",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session tuned for this engine (AQE, UTC, no UI).

    ``spark.checkpoint.dir`` is set to a fresh folder only when the
    environment has none, as in tests.
    """
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.localShuffleReader.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KPIFORGE_DRIVER_MEMORY", "8g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only if unset.

    The scratch fallback is for ``local[...]`` masters (tests, single
    machine).  On a cluster a machine-local folder is not shared, so an
    unset ``spark.checkpoint.dir`` is an error there.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at storage shared by all executors"
            )
        current = tempfile.mkdtemp(prefix="kpiforge-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints and written tables."""
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; point it at storage shared by all executors"
        )
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/kpiforge/{name}-{uuid.uuid4().hex}"


_lock = threading.Lock()
_dropping: dict[str, list] = {}


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that runs inside the block go when it ends, not when the driver next collects its garbage.

    For queries that write their result: what reads it needs no shuffle of
    theirs.  The session's own setting is back when the last of all blocks
    of a session ends (they may nest, or run beside each other).
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        blocks = _dropping.setdefault(session, [0, spark.conf.get(CLEANUP_CONF, None)])
        blocks[0] += 1
        spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        with _lock:
            blocks[0] -= 1
            if not blocks[0]:
                del _dropping[session]
                if blocks[1] is None:
                    spark.conf.unset(CLEANUP_CONF)
                else:
                    spark.conf.set(CLEANUP_CONF, blocks[1])


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are deleted at its end.

    For jobs that finish their work (write their outputs) before they leave.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that is read from them is written.

    A table without rows may have no files to tell its folder; it stays.
    """
    for df in tables:
        for name in df.inputFiles()[:1]:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(
    df: DataFrame,
    name: str,
    partition_by: list[str] | None = None,
    sort_within: list[str] | None = None,
) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of
    re-running the whole plan), and later filters push into the Parquet
    scan of the written table.  ``sort_within`` sorts each task's rows
    (no shuffle) so row-group min/max statistics are narrow on those
    columns and pushed filters skip row groups.  The shuffle files of the
    write go with it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.parquet(path)
