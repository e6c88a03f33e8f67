"""Publishing several tables at once.

Tables are written to a new folder each time; a small JSON pointer, replaced
by one atomic rename, says which folder is current.  Readers follow the
pointer, so they see a whole set of tables of one age, also while the next
set is being written or after a failed attempt.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Small jobs that wait for nothing of each other are handed to the scheduler together.
AT_ONCE = 8


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """The pointer's content; None if nothing was published yet."""
    fs = _files(spark, path)
    if not fs.exists(_path(spark, path)):
        return None
    stream = fs.open(_path(spark, path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def replace_pointer(spark: SparkSession, path: str, content: dict) -> None:
    """Write the pointer beside its place and move it there in one step."""
    jvm, fs = spark._jvm, _files(spark, path)
    temp = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, temp))
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_path(spark, temp), _path(spark, path), options)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this job wrote and nothing refers to any more."""
    _files(spark, path).delete(_path(spark, path), True)


def at_once(spark: SparkSession, *jobs: Callable) -> list:
    """Results of ``jobs``, which run beside each other; the first failure is raised."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each table to ``<folder>/<name>``; returns the paths."""

    def write(name: str, df: DataFrame) -> Callable:
        return lambda: df.write.mode("overwrite").parquet(f"{folder}/{name}")

    if tables:
        at_once(next(iter(tables.values())).sparkSession, *[write(name, df) for name, df in tables.items()])
    return {name: f"{folder}/{name}" for name in tables}


def published(spark: SparkSession, out: str) -> dict[str, str]:
    """Paths of the tables that are current under ``out``."""
    current = read_pointer(spark, f"{out.rstrip('/')}/current.json")
    if current is None:
        raise FileNotFoundError(f"nothing is published under {out} yet")
    return current["tables"]
