"""Rows by key in runs, looked up without reading the history.

A store is a list of runs.  A run holds the newest rows of the keys that one
batch touched, dealt into buckets by the leading bits of the key's hash (a
Parquet partition each, sorted by hash), and a Bloom filter per bucket: rows
of 32,768-bit bitmaps (``bitmap_construct_agg``), every key setting PROBES
bits of one of them.  A look-up reads the filters of the buckets that its
keys fall into, then the rows of the buckets that may hold one of them; what
it reads is bounded by its keys, not by the store.  All rows of a key are
written together, and the run with the highest version wins.

Runs are merged tier by tier, so their number stays logarithmic.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.sinks.versions import at_once

BUCKET_ROWS = 100_000
MAX_BUCKETS = 4096
PROBES = 4
BITMAP_BITS = 32_768
KEYS_PER_BITMAP = BITMAP_BITS // 16
WORKING = ["_h", "_v"]


def _bucket(h: Column, buckets: int) -> Column:
    """The leading bits of the hash; ``buckets`` is a power of two."""
    bits = buckets.bit_length() - 1
    return (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0)).cast("int")


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(-1)), F.lit(blocks)).cast("int")


def _bit(h: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(probe)), F.lit(BITMAP_BITS)).cast("long")


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


@dataclass
class KeyedStore:
    """How one kind of rows is stored: its key columns, its row schema and where runs go."""

    spark: SparkSession
    folder: str
    name: str
    keys: list[str]
    schema: T.StructType
    merge_runs: int = 16

    def hashed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the key's hash ``_h``; a null is a value like any other."""
        return rows.withColumn("_h", F.xxhash64(*[F.col(k) for k in self.keys]))

    def write(self, rows: DataFrame, version: int, tier: int = 0, count: int | None = None) -> dict:
        """Write ``rows`` (all rows of their keys) as a new run and return its description.

        ``count`` (about as many rows as there are) sizes buckets and filters.
        ``rows`` is read twice, side by side: it should be a written table or a short plan over one.
        """
        path = f"{self.folder}/{self.name}-{uuid.uuid4().hex}"
        if count is None:
            count = rows.count()
        buckets = 1
        while buckets < MAX_BUCKETS and buckets * BUCKET_ROWS < count:
            buckets *= 2
        blocks = max(1, -(-count // (buckets * KEYS_PER_BITMAP)))  # bitmaps of a bucket
        rows = self.hashed(rows)
        if "_v" not in rows.columns:
            rows = rows.withColumn("_v", F.lit(version).cast("long"))
        rows = rows.withColumn("_b", _bucket(F.col("_h"), buckets))
        bits = rows.select("_b", _block(F.col("_h"), blocks).alias("block"), F.explode(F.array(*[_bit(F.col("_h"), p) for p in range(PROBES)])).alias("bit"))
        bloom = bits.groupBy("_b", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        dealt = rows.select(*[f.name for f in self.schema], *WORKING, "_b").repartition(buckets, "_b").sortWithinPartitions("_b", "_h")
        at_once(
            self.spark,
            lambda: dealt.write.partitionBy("_b").parquet(f"{path}/rows"),
            lambda: bloom.repartition(1 if buckets == 1 else min(buckets, 64), "_b").write.partitionBy("_b").parquet(f"{path}/bloom"),
        )
        return {"tier": tier, "path": path, "rows": count, "buckets": buckets, "blocks": blocks}

    def _rows(self, run: dict) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_h", T.LongType()), T.StructField("_v", T.LongType()), T.StructField("_b", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{run['path']}/rows")

    def _bloom(self, run: dict) -> DataFrame:
        return self.spark.read.schema("block int, bitmap binary, _b int").parquet(f"{run['path']}/bloom")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def candidates(self, runs: list[dict], keys: DataFrame) -> DataFrame | None:
        """Rows of the buckets that may hold one of ``keys`` (a frame with ``_h``), per run; None if there are none."""
        if not runs:
            return None
        finest = max(r["buckets"] for r in runs)
        touched = sorted(r[0] for r in keys.select(_bucket(F.col("_h"), finest)).distinct().collect())  # MAX_BUCKETS at most
        tests = None
        for n, run in enumerate(runs):
            mine = sorted({b // (finest // run["buckets"]) for b in touched})
            asked = keys.select("_h", _bucket(F.col("_h"), run["buckets"]).alias("_b"), _block(F.col("_h"), run["blocks"]).alias("block"))
            bloom = self._bloom(run).where(F.col("_b").isin(mine))
            may = F.lit(True)
            for p in range(PROBES):
                may = may & _is_set(F.col("bitmap"), _bit(F.col("_h"), p))
            found = asked.join(bloom, ["_b", "block"]).where(may).select(F.lit(n).alias("run"), "_b").distinct()
            tests = found if tests is None else tests.unionByName(found)
        hits: dict[int, list[int]] = {}
        for r in tests.collect():  # runs x buckets at most
            hits.setdefault(r["run"], []).append(r["_b"])
        frames = [self._rows(runs[n]).where(F.col("_b").isin(sorted(b))).drop("_b") for n, b in sorted(hits.items())]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    def look_up(self, runs: list[dict], keys: DataFrame) -> DataFrame:
        """The newest rows of ``keys`` (a frame of distinct keys with ``_h``)."""
        found = self.candidates(runs, keys)
        if found is None:
            return self._empty()
        asked = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("_h").alias("_kh"))
        same = F.col("_h") == F.col("_kh")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return self._newest(found.join(asked, same, "left_semi"))

    def _newest(self, rows: DataFrame, keep_version: bool = False) -> DataFrame:
        newest = Window.partitionBy("_h", *self.keys).orderBy(F.col("_v").desc())
        rows = rows.withColumn("_r", F.rank().over(newest)).where("_r = 1")
        return rows.select(*[f.name for f in self.schema], *(["_v"] if keep_version else []))

    def everything(self, runs: list[dict], keep_version: bool = False) -> DataFrame:
        """The newest rows of all keys: reads the whole store."""
        out = None
        for run in runs:
            df = self._rows(run).drop("_b")
            out = df if out is None else out.unionByName(df)
        return self._empty() if out is None else self._newest(out, keep_version)

    def merged(self, runs: list[dict], drop: Column | None = None) -> list[dict]:
        """Merge runs, ``merge_runs`` of one tier into one of the next.

        Rows where ``drop`` holds are left out when nothing older remains that they must hide.
        """
        tier = 0
        while any(r["tier"] >= tier for r in runs):
            same = [r for r in runs if r["tier"] == tier]
            if len(same) >= self.merge_runs:
                rest = [r for r in runs if r["tier"] != tier]
                rows = self.everything(same, keep_version=True)
                if drop is not None and not rest:
                    rows = rows.where(~drop)
                runs = rest + [self.write(rows, 0, tier + 1, sum(r["rows"] for r in same))]
            tier += 1
        return runs
