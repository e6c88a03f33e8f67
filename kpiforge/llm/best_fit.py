"""Bulk-synchronous best-fit packing.

Round by round, the documents that are not placed yet and the gaps of open
sequences are sorted together by size, in range partitions.  A sweep from
large to small gives every document the smallest free gap that holds it (its
successor in size): within a partition first, then across partitions by the
ranks of what is left, for which only counts per partition reach the driver.
Every gap takes one document a round, its remainder is a new gap.  Documents
larger than every gap open new sequences, no more than their total needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm.common import prepare, written
from kpiforge.llm.tokens import engine

CAPACITY = 1024
END_ID = 2
# Rows that one range partition of a round is planned for.
ROWS_PER_PARTITION = 20_000

ITEM, GAP = 1, 0


# --------------------------------------------------------------------------- sweep


def match_in_order(is_item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mates in a sequence sorted by size, largest first: items take the last free gap before them.

    Returns ``(mate, free)``: the gap's position for each matched item (else
    -1), and whether a row found no mate.
    """
    n = len(is_item)
    mate = np.full(n, -1, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    if not n:
        return mate, free
    depth = np.cumsum(np.where(is_item, -1, 1))
    lowest = np.minimum(np.minimum.accumulate(np.concatenate([[0], depth[:-1]])), 0)
    stranded = is_item & (depth < lowest)  # no free gap is at least as large
    use = np.flatnonzero(~stranded)
    item = is_item[use]
    level = np.cumsum(np.where(item, -1, 1)) + item  # a gap and the item that takes it have one level
    order = np.argsort(level, kind="stable")
    items = np.flatnonzero(item[order])
    mate[use[order[items]]] = use[order[items - 1]]
    free[use[order[items]]] = False
    free[use[order[items - 1]]] = False
    return mate, free


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches within a range partition; what is left gets its rank there."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    size, kind, uid = (t.column(c).to_numpy() for c in ("size", "kind", "uid"))
    mate, free = match_in_order(kind == ITEM)
    rank = np.full(len(size), -1, dtype=np.int64)
    for k in (ITEM, GAP):
        rest = free & (kind == k)
        rank[rest] = np.arange(rest.sum())
    # smaller free gaps that follow before the next item: `left` items never need more of a run than its last `left`
    loose = free & (kind == GAP)
    after = np.cumsum(loose[::-1])[::-1] - loose
    runs = np.flatnonzero(kind == ITEM)
    until = np.append(after[runs] if len(runs) else [], 0)[np.searchsorted(runs, np.arange(len(size)))]
    tail = (after - until).astype(np.int64)
    keep = free | (mate >= 0)  # a taken gap is told by the item that took it
    got = np.maximum(mate, 0)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(keep.sum(), TaskContext.get().partitionId(), dtype=np.int32)),
            pa.array(kind[keep]),
            pa.array(uid[keep]),
            pa.array(size[keep]),
            pa.array(rank[keep]),
            pa.array(tail[keep]),
            pa.array(uid[got][keep]),
            pa.array(size[got][keep]),
        ],
        names=["part", "kind", "uid", "size", "rank", "tail", "gap_uid", "gap_size"],
    )


_SWEPT = "part int, kind int, uid long, size int, rank long, tail long, gap_uid long, gap_size int"


def _left_over(taken: dict[int, int], spare: dict[int, int], left: int):
    """What a round left: items from rank ``taken[part]`` on, and gaps below rank ``spare[part]`` that may be of use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, kind, rank, tail = (b.column(c).to_numpy() for c in ("part", "kind", "rank", "tail"))
            low = np.array([taken.get(p, 0) for p in part.tolist()], dtype=np.int64)
            high = np.array([spare.get(p, 0) for p in part.tolist()], dtype=np.int64)
            keep = np.where(kind == ITEM, rank >= low, (rank < high) & (tail < left))
            yield b.filter(pa.array(keep)).select(["part", "kind", "uid", "size", "rank"])

    return run


def _across(left: dict[int, tuple[int, int]]) -> tuple[list[tuple], dict[int, int], dict[int, int]]:
    """Match left-over items with gaps of earlier (larger) partitions, by counts alone.

    ``left``: items and gaps left in each partition.  Returns segments
    ``(item part, first rank, end rank, gap part, gap rank of the first)``,
    in which gap ranks fall as item ranks rise, and the matched items and
    the remaining gaps of each partition.
    """
    stack: list[list[int]] = []
    segments, taken, gaps = [], {}, {p: g for p, (_, g) in left.items()}
    for p in sorted(left):
        items, at = left[p][0], 0
        while at < items and stack:
            q, g = stack[-1]
            k = min(items - at, g)
            segments.append((p, at, at + k, q, g - 1))
            at += k
            stack[-1][1] -= k
            gaps[q] -= k
            if not stack[-1][1]:
                stack.pop()
        taken[p] = at
        if left[p][1]:
            stack.append([p, left[p][1]])
    return segments, taken, gaps


def _numbers(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few numbers per range partition, never more; small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


# -------------------------------------------------------------------------- bundles


def _bundle(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, uid = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()
            if not len(size):
                continue
            before = np.concatenate([[0], np.cumsum(size)[:-1]])
            group = before // target
            first = np.concatenate([[True], group[1:] != group[:-1]])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(size)), 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array(size.astype(np.int32)), pa.array(uid[lead]), pa.array((before - before[lead]).astype(np.int32))],
                names=["uid", "size", "lead", "inner"],
            )

    return run


def _bundled(small: DataFrame, target: int) -> DataFrame:
    """Join runs of small documents into bundles of about ``target``: ``(uid, size, lead, inner)``."""
    spread = small.select(F.col("size").cast("int").alias("size"), "uid").sortWithinPartitions(F.col("size").desc())
    return written(spread.mapInArrow(_bundle(target), "uid long, size int, lead long, inner int"), "pack-bundles")


# ---------------------------------------------------------------------------- rounds


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``items(uid long, size int)`` into sequences of ``capacity``.

    Returns ``(uid, sequence_id long, offset long)``, one row per item;
    ``sequence_id`` is the uid of the item that opened the sequence and
    offsets are gapless from 0.  Sizes must be in 1..capacity and uids
    unique.  An empty table gives an empty table.

    Where documents outnumber the gaps by more than two to one, small ones
    are joined into bundles (of up to an eighth of the capacity) that are
    placed as one, so a few gaps do not take many documents one a round.
    """
    spark = items.sparkSession
    whole = items.filter(F.col("size") == capacity)
    rest = items.filter(F.col("size") < capacity)
    zero = F.lit(0).cast("long").alias("offset")
    opens = F.col("size") * 2 > capacity
    placed = [whole.select("uid", F.col("uid").alias("sequence_id"), zero)]
    placed.append(rest.filter(opens).select("uid", F.col("uid").alias("sequence_id"), zero))
    gaps = rest.filter(opens).select("uid", (F.lit(capacity) - F.col("size")).cast("int").alias("size"))
    todo = rest.filter(~opens).select("uid", "size")

    by_size = {(r["kind"], r["size"]): r["count"] for r in rest.groupBy(F.when(opens, GAP).otherwise(ITEM).alias("kind"), F.when(opens, capacity - F.col("size")).otherwise(F.col("size")).alias("size")).count().collect()}
    left = sum(k for (kind, _), k in by_size.items() if kind == ITEM)
    n_gaps = sum(k for (kind, _), k in by_size.items() if kind == GAP)
    bundles: list[DataFrame] = []

    while left:
        total = sum(n * k for (kind, n), k in by_size.items() if kind == ITEM)
        largest = max([n for (kind, n), k in by_size.items() if kind == GAP and k], default=capacity)
        target = min(capacity // 8, largest, total // max(1, n_gaps, -(-total // capacity))) // 2
        least = min(n for (kind, n), k in by_size.items() if kind == ITEM and k)
        if left > 2 * max(n_gaps, -(-total // capacity)) and target >= 2 * least:
            joined = _bundled(todo.filter(F.col("size") <= target), target)
            bundles.append(joined)
            todo = todo.filter(F.col("size") > target).unionByName(joined.groupBy(F.col("lead").alias("uid")).agg(F.sum("size").cast("int").alias("size")))
            todo = written(todo.select("uid", F.col("size").cast("int").alias("size")), "pack-todo")
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), (left + n_gaps) // ROWS_PER_PARTITION + 1))
        events = todo.select("uid", F.col("size").cast("int").alias("size"), F.lit(ITEM).alias("kind")).unionByName(
            gaps.select("uid", "size", F.lit(GAP).alias("kind"))
        )
        order = [F.col("size").desc(), F.col("kind").asc(), F.xxhash64("uid").asc()]
        swept = written(events.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "pack-swept")
        loose = swept.filter(F.col("rank") >= 0)
        counts = loose.groupBy("part").agg(F.count_if(F.col("kind") == ITEM).alias("i"), F.count_if(F.col("kind") == GAP).alias("g"))
        free = {r["part"]: (r["i"], r["g"]) for r in counts.collect()}
        segments, taken, spare = _across(free)

        found = swept.filter(F.col("rank") < 0).select("uid", "size", "gap_uid", "gap_size")
        if segments:
            seg = _numbers(spark, segments, "part int, first long, end long, gap_part int, gap_top long")
            far = loose.filter(F.col("kind") == ITEM).select("part", "rank", "uid", "size").join(seg, "part")
            far = far.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
            far = far.select("uid", "size", "gap_part", (F.col("gap_top") - F.col("rank") + F.col("first")).alias("gap_rank"))
            open_gaps = loose.filter(F.col("kind") == GAP).select(
                F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("uid").alias("gap_uid"), F.col("size").alias("gap_size")
            )
            found = found.unionByName(far.join(open_gaps, ["gap_part", "gap_rank"]).select("uid", "size", "gap_uid", "gap_size"))
        found = written(found, "pack-found")
        placed.append(found.select("uid", F.col("gap_uid").alias("sequence_id"), (F.lit(capacity) - F.col("gap_size")).cast("long").alias("offset")))

        left = sum(i - taken[p] for p, (i, _) in free.items())
        rest = written(loose.mapInArrow(_left_over(taken, spare, left), "part int, kind int, uid long, size int, rank long"), "pack-rest")
        renewed = found.filter("gap_size > size").select(F.col("gap_uid").alias("uid"), (F.col("gap_size") - F.col("size")).alias("size"))
        # Sizes of what is left, in at most 2 x capacity rows: what must open, and from which size on gaps are of use.
        sizes = rest.select("kind", "size").unionByName(renewed.select(F.lit(GAP).alias("kind"), "size")).groupBy("kind", "size")
        by_size = {(r["kind"], r["size"]): r["count"] for r in sizes.count().collect()}
        largest = max([n for kind, n in by_size if kind == GAP], default=0)  # no gap holds a larger one
        new = -(-sum(n * k for (kind, n), k in by_size.items() if kind == ITEM and n > largest) // capacity)
        left -= new

        # the first `new` unplaced items, from the largest on, open sequences
        opening, begin = new, {}
        for p in sorted(free):
            begin[p] = taken[p] + min(opening, free[p][0] - taken[p])
            opening -= begin[p] - taken[p]
        opening = new
        for n in sorted((n for kind, n in by_size if kind == ITEM), reverse=True):
            k = min(opening, by_size[ITEM, n])
            opening -= k
            by_size[ITEM, n] -= k
            by_size[GAP, capacity - n] = by_size.get((GAP, capacity - n), 0) + k
        todo, gaps = rest.filter(F.col("kind") == ITEM), rest.filter(F.col("kind") == GAP).select("uid", "size").unionByName(renewed)
        if new:
            todo = todo.join(_numbers(spark, list(begin.items()), "part int, upto long"), "part")
            opened = todo.filter("rank < upto").select("uid", "size")
            todo = todo.filter("rank >= upto")
            placed.append(opened.select("uid", F.col("uid").alias("sequence_id"), zero))
            gaps = gaps.unionByName(opened.select("uid", (F.lit(capacity) - F.col("size")).alias("size")))
        todo = todo.select("uid", "size")
        least = min([n for (kind, n), k in by_size.items() if kind == ITEM and k], default=capacity)
        gaps = gaps.filter(F.col("size") >= least)
        n_gaps = sum(k for (kind, n), k in by_size.items() if kind == GAP and n >= least)

    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df)
    for joined in reversed(bundles):
        inside = out.join(joined.select(F.col("lead").alias("uid"), F.col("uid").alias("member"), "inner"), "uid", "left")
        out = inside.select(F.coalesce("member", "uid").alias("uid"), "sequence_id", (F.col("offset") + F.coalesce("inner", F.lit(0))).alias("offset"))
    return out


# -------------------------------------------------------------------------- documents


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full pieces behind a first shorter one."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return [head] * (head > 0) + [capacity] * (n // capacity)


def _pieces(path: str, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = engine(path, pattern)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = enc.encode_to_numpy(text) if text else np.zeros(0, np.uint32)
                ids = np.append(ids, end_id).astype("<u4")
                at = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Tokenise every whole text, cut overlong documents and pack the pieces.

    Returns a row per piece: the id column, ``piece``, ``start`` (tokens of
    the document before it), ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``.  Null text counts as empty (its end id alone is packed);
    null or repeated ids and repeated rows are packed row by row; other
    columns are not read; an empty table gives an empty table.  Texts of any
    length are cut without loss: full pieces behind a first shorter one.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _pieces(vocabulary, pattern, capacity, end_id), f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    places = pack(pieces.select("uid", F.col("length").cast("int").alias("size")), capacity)
    return pieces.join(places, "uid").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
