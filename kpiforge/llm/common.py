"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import ensure_checkpoint_dir, materialize

# At most this many keys are ever broadcast by ``hot_split_join``: keys that
# hold at least 1/HOT_KEYS of the rows, of which there can be HOT_KEYS.
HOT_KEYS = 1000


# Bits of the filter of ``marked_likely``, and those of one of its bitmaps (``bitmap_construct_agg``).
FILTER_BITS, BITMAP_BITS = 1 << 25, 32_768

# Rows of an Arrow batch: whole texts pass through Python workers, and this bounds what one holds at a time.
ARROW_ROWS = 1000
ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """The shared folder is known, and Arrow batches of whole texts are small."""
    ensure_checkpoint_dir(spark)
    if not 0 < int(spark.conf.get(ARROW_CONF)) <= ARROW_ROWS:
        spark.conf.set(ARROW_CONF, str(ARROW_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back."""
    prepare(df.sparkSession)
    return materialize(df, f"llm-{name}")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    mod = sys.modules.get("_kpiforge_llm_cache")
    if mod is None:
        mod = sys.modules["_kpiforge_llm_cache"] = types.ModuleType("_kpiforge_llm_cache")
        mod.store = {}
    return mod.store


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def boxed(df: DataFrame, without: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """The ``named`` columns, and ``df``'s own columns in one struct ``row``.

    Operators add working columns beside ``row``; they cannot clash with a
    user's columns, which stay inside the struct.  Columns named in
    ``without`` are left out of it (large ones that are carried beside it).
    """
    fields = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return df.select(*[c.alias(n) for n, c in named.items()], F.struct(*fields, F.lit(True).alias("_boxed")).alias("row"))


def unboxed(df: DataFrame, columns: list[str], replace: dict[str, Column] | None = None, add: dict[str, Column] | None = None) -> DataFrame:
    """Open ``row`` into ``columns``; ``replace`` gives new values, ``add`` appends columns.

    An added name that ``columns`` already has (in any case) gets
    underscores appended until it is free.
    """
    replace = replace or {}
    cols = [replace[c].alias(c) if c in replace else F.col("row").getField(c).alias(c) for c in columns]
    used = {c.lower() for c in columns}
    for name, col in (add or {}).items():
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        cols.append(col.alias(name))
    return df.select(*cols)


def hot_split_join(big: DataFrame, keyed: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join ``big`` with ``keyed`` (one row per key) that a hot key cannot skew.

    ``keyed[rows]`` counts the rows of each key in ``big``, ``total`` all of
    them.  Keys with at least ``total / HOT_KEYS`` rows, at most HOT_KEYS of
    them, are broadcast, so their rows never meet in one task; the other
    keys are small and are joined by a shuffle.
    """
    limit = max(1.0, total / HOT_KEYS)
    hot = keyed.filter((F.col(rows) >= limit) & (F.col(rows) > 1000))
    cold = keyed.filter(~((F.col(rows) >= limit) & (F.col(rows) > 1000)))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(cold, keys))


def marked_likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` with ``_likely``: true for all whose key is in ``wanted``, and for a few others; a null key is a value like any other.

    Keys set one of FILTER_BITS bits, in bitmaps of 4 MB in all that every
    task gets, so a join after it moves few rows that it does not want.
    """
    def place(df: DataFrame, name: str):
        return F.pmod(F.xxhash64(df[name]), F.lit(FILTER_BITS))

    bits = wanted.select(place(wanted, wanted_key).alias("at"))
    bits = bits.groupBy(F.floor(F.col("at") / BITMAP_BITS).cast("int").alias("_of")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("_bitmap"))
    at = F.col("_at") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("_at", place(rows, key)).withColumn("_of", F.floor(F.col("_at") / BITMAP_BITS).cast("int"))
    is_set = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    found = placed.join(F.broadcast(bits), "_of", "left").withColumn("_likely", is_set)
    return found.select(*[F.col(f"`{c}`") for c in [*rows.columns, "_likely"]])


def likely_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The ``rows`` whose key is in ``wanted``, and a few others."""
    return marked_likely(rows, key, wanted, wanted_key).filter("_likely").drop("_likely")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)``.

    ``root`` is the smallest node of the component.  Every round hooks each
    node to its smallest neighbour (a map-side combined minimum), jumps
    pointers twice and contracts the edges; links stay distributed and each
    round's tables are written, so a lost executor re-reads files.  Nodes
    without links (or only links to themselves) are not returned.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter(F.col("a") != F.col("b")).select(hi.alias("hi"), lo.alias("lo")).distinct()

    cur = written(tidy(edges), "cc-edges")
    hooks: list[DataFrame] = []
    nodes = cur.select(F.col("hi").alias("node")).union(cur.select(F.col("lo").alias("node"))).distinct()
    while cur.limit(1).count():
        up = written(cur.groupBy("hi").agg(F.min("lo").alias("up")), "cc-hooks")
        for _ in range(2):
            up2 = up.select(F.col("hi").alias("mid"), F.col("up").alias("far"))
            up = up.join(up2, up["up"] == up2["mid"], "left").select("hi", F.coalesce("far", "up").alias("up"))
        up = written(up, "cc-jumped")
        hooks.append(up)
        to_hi = up.select("hi", F.col("up").alias("a"))
        to_lo = up.select(F.col("hi").alias("lo"), F.col("up").alias("b"))
        cur = written(
            tidy(cur.join(to_hi, "hi").join(to_lo, "lo", "left").select("a", F.coalesce("b", "lo").alias("b"))),
            "cc-edges",
        )
    labels = nodes.withColumn("root", F.col("node"))
    for up in hooks:
        step = up.select(F.col("hi").alias("root"), "up")
        labels = labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return written(labels, "cc-labels")
