"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Components are integers (a floor of a scaled float), so distances, sums and
ties are exact and equal on every machine.  Nearest entries are found by
slice-and-intersect bitmasks: for every dimension the entries' coordinates
are sorted, and prefix masks say which entries lie before a place in that
order.  The distance to one probed entry is the initial radius; two binary
searches a dimension turn it into the mask of the entries inside the range,
and the AND of all dimensions' masks leaves the only entries that can be as
near.  Those are compared exactly.  Each round of training is one pass over
the vectors that returns sums per entry; only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import boxed, hot_split_join, prepare, unboxed, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Components may have this magnitude after scaling: squared distances and sums stay within 64 bits.
LARGEST = 1 << 28
WORD = 64


class Slices:
    """One part's entries, ready for exact nearest-entry searches."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        self.words = (k + WORD - 1) // WORD
        bits = np.zeros((k, self.words), dtype=np.uint64)
        bits[np.arange(k), np.arange(k) // WORD] = np.uint64(1) << (np.arange(k) % WORD).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[order[:, d], d].copy() for d in range(width)]
        # before[d][j]: the entries at the first j places of dimension d
        none = np.zeros((1, self.words), dtype=np.uint64)
        self.before = [np.concatenate([none, np.bitwise_or.accumulate(bits[order[:, d]], axis=0)]) for d in range(width)]
        self.widest = int(np.argmax(entries.max(axis=0) - entries.min(axis=0))) if width else 0
        self.order = order

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (the lowest of equally near ones) and squared distance of the nearest entry of each row."""
        n, width = x.shape
        if not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        p = self.widest
        near = self.order[np.minimum(np.searchsorted(self.sorted[p], x[:, p]), len(self.entries) - 1), p]
        radius = np.sqrt(((x - self.entries[near]) ** 2).sum(axis=1).astype(float)).astype(np.int64) + 1
        mask = np.full((n, self.words), ~np.uint64(0))
        for d in range(width):
            first = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            last = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            mask &= self.before[d][last] ^ self.before[d][first]
        best, distance = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        for k, entry in enumerate(self.entries):
            rows = np.flatnonzero(mask[:, k // WORD] & (np.uint64(1) << np.uint64(k % WORD)))
            far = ((x[rows] - entry) ** 2).sum(axis=1)
            closer = far < distance[rows]
            best[rows[closer]], distance[rows[closer]] = k, far[closer]
        return best, distance


@dataclass
class Codebooks:
    """Entries of every part (``entries x width`` integers each), for vectors of ``dim`` components."""

    parts: list[np.ndarray]
    dim: int
    scale: int

    def sha256(self) -> str:
        text = ",".join(str(v) for part in self.parts for v in part.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        ends = _bounds(self.dim, len(self.parts))
        return [x[:, a:b] for a, b in zip(ends, ends[1:])]


def _bounds(dim: int, parts: int) -> list[int]:
    """Where the consecutive parts of a vector begin and end: equal ones if ``parts`` divides ``dim``."""
    return [dim * i // parts for i in range(parts + 1)]


def _integers(vectors: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """Rows with a usable vector (of ``dim`` components if given), and their integer components."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    values = lists.values.to_numpy(zero_copy_only=False)  # null components read as NaN
    at = lists.offsets.to_numpy()
    sizes = np.diff(at)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    if dim is not None:
        usable &= sizes == dim
    rows = np.flatnonzero(usable)
    inside = np.zeros(len(values) + 1, dtype=np.int64)
    np.add.at(inside, at[rows], 1)
    np.add.at(inside, at[rows + 1], -1)
    whole = np.floor(values[np.cumsum(inside[:-1]) > 0] * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"components beyond +-{LARGEST / scale:.0f} are not supported")
    whole = whole.astype(np.int64)
    if dim is not None:
        return rows, whole.reshape(len(rows), dim)
    return rows, np.split(whole, np.cumsum(sizes[rows])[:-1]) if len(rows) else []


def _integer_udf(scale: int):
    @F.arrow_udf("array<bigint>")
    def run(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        for i, v in zip(*_integers(vectors, scale)):
            out[i] = v
        return pa.array(out, pa.list_(pa.int64()))

    return run


def _summer(books: Codebooks):
    """Counts and sums of the parts nearest to every entry, one row each for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(p) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        sums = [np.zeros_like(p) for p in books.parts]
        for b in batches:
            _, x = _integers(b.column(0), books.scale, books.dim)
            for i, part in enumerate(books.cut(x)):
                best, _ = slices[i].nearest(part)
                counts[i] += np.bincount(best, minlength=len(counts[i]))
                np.add.at(sums[i], best, part)
        rows = [(i, k, -1, int(n)) for i, c in enumerate(counts) for k, n in enumerate(c) if n]
        rows += [(i, k, d, int(sums[i][k, d])) for i, k, at, _ in list(rows) for d in range(sums[i].shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["part", "entry", "at", "total"],
        )

    return run


def fit_codebooks(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks after ``rounds`` of assignment and floor means; None if no vector can be used.

    They start as the parts of the ``entries`` smallest ids' vectors (fewer
    if there are fewer; of equal ids the smaller vector first, null ids
    last).  An entry that no part is nearest to stays as it is.
    """
    prepare(vectors.sparkSession)
    whole = vectors.select(F.col(f"`{id_col}`").alias("id"), _integer_udf(scale).asNondeterministic()(F.col(f"`{vector_col}`")).alias("v"))
    first = whole.filter(F.col("v").isNotNull()).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    dim = len(first[0]["v"])
    start = [r["v"] for r in first if len(r["v"]) == dim]
    start = np.array(start, dtype=np.int64).reshape(len(start), dim)
    ends = _bounds(dim, parts)
    books = Codebooks([start[:, a:b].copy() for a, b in zip(ends, ends[1:])], dim, scale)
    only = vectors.select(F.col(f"`{vector_col}`").alias("v"))
    for _ in range(rounds):
        sums = only.mapInArrow(_summer(books), "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
        found = {(r["part"], r["entry"], r["at"]): r["total"] for r in sums.collect()}  # at most entries x (dim + parts) numbers
        for (part, entry, at), total in found.items():
            if at >= 0:
                books.parts[part][entry, at] = total // found[part, entry, -1]
    return books


def _encoder(books: Codebooks):
    digits = max(2, len(f"{max(len(p) for p in books.parts) - 1:x}"))

    @F.arrow_udf("struct<code:string,error:bigint>")
    def run(vectors: pa.Array) -> pa.Array:
        rows, x = _integers(vectors, books.scale, books.dim)
        found = [Slices(p).nearest(part) for p, part in zip(books.parts, books.cut(x))]
        code, error = np.full(len(vectors), None, dtype=object), np.zeros(len(vectors), np.int64)
        for i, row in enumerate(np.stack([k for k, _ in found], axis=1).tolist()):
            code[rows[i]] = "".join(f"{k:0{digits}x}" for k in row)
        error[rows] = sum(e for _, e in found)
        return pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(error)], names=["code", "error"])

    return run


def encode(
    vectors: DataFrame, books: Codebooks | None, vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Replace the vector column by ``code`` and ``error``; add ``label_error`` and ``codebooks_sha256``.

    ``code`` holds the entry index of every part (two hex digits, more where
    a codebook has over 256 entries), ``error`` the squared distances summed
    over the parts, ``label_error`` the errors summed over rows with an
    equal label (null labels together).

    Edge cases: rows whose vector is null, holds null or non-finite
    components or has another length than the codebooks are dropped; a
    component too large for exact 64-bit sums is an error; repeated rows and
    ids are kept; extra columns stay, a clashing name gets underscores;
    without codebooks (no usable vector) the result is empty.
    """
    spark = vectors.sparkSession
    prepare(spark)
    label = F.col(f"`{label_col}`")
    key = F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))
    others = [c for c in vectors.columns if c != vector_col]
    coded = _encoder(books).asNondeterministic()(F.col(f"`{vector_col}`")) if books else F.lit(None).cast("struct<code:string,error:bigint>")
    whole = boxed(vectors, (vector_col,), key=key, done=coded)
    whole = written(whole.filter(F.col("done")["code"].isNotNull()), "vector-codes")
    sums = written(whole.groupBy("key").agg(F.sum(F.col("done")["error"]).alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    joined = hot_split_join(whole, sums, ["key"], "n", sums.agg(F.sum("n")).first()[0] or 0)
    return unboxed(
        joined,
        others,
        add={
            "code": F.col("done")["code"],
            "error": F.col("done")["error"],
            "label_error": F.col("label_error"),
            "codebooks_sha256": F.lit(books.sha256() if books else None).cast("string"),
        },
    )


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", vector_col: str = "embedding") -> DataFrame:
    """Add the vector of entries that each code stands for; null for a null code."""
    digits = max(2, len(f"{max(len(p) for p in books.parts) - 1:x}"))
    parts = [
        F.element_at(
            F.array(*[F.array(*[F.lit(float(v) / books.scale) for v in entry]).cast("array<double>") for entry in part]),
            F.conv(F.substring(F.col(f"`{code_col}`"), digits * i + 1, digits), 16, 10).cast("int") + 1,
        )
        for i, part in enumerate(books.parts)
    ]
    return codes.withColumn(vector_col, F.concat(*parts))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how: int) -> DataFrame:
    """``fit_codebooks`` on all vectors, then ``encode`` of all of them."""
    return encode(vectors, fit_codebooks(vectors, id_col, vector_col, **how), vector_col, label_col)
