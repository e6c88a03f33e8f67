"""Packed token matrices: best-fit-decreasing packing written as binary files.

Every task tokenises its documents, cuts overlong ones without loss and
packs windows of pieces, largest first, each into the open row with the
least room that holds it; a segment tree over capacities finds it.  Rows
are written as matrices of token ids; the index says which file and row a
sequence is, where its segments begin and end (cumulative lengths) and
where positions start from 0 again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.llm.best_fit import CAPACITY, END_ID, cut
from kpiforge.llm.common import prepare, written
from kpiforge.llm.tokens import engine
from kpiforge.llm.warc import open_folder

# Pieces that are packed together: bounds a task's memory to WINDOW x capacity ids.
WINDOW = 16_384
PAD_ID = 0


class CapacityTree:
    """Segment tree over capacities 0..n: how many open rows have just that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def least_from(self, need: int) -> int:
        """The least room of at least ``need`` that some row has; -1 if none."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # a right sibling holds larger rooms
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def pack_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the positions of the pieces in each row, in placing order."""
    tree = CapacityTree(capacity)
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        room = tree.least_from(n) if n < capacity else -1
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > n:
            open_rows[room - n].append(row)
            tree.add(room - n, 1)
    return rows


_INDEX = "file string, row int, dtype string, n_tokens long, cu_seqlens array<int>, position_resets array<int>, pieces array<int>, starts array<long>"


def _write(uri: str, vocabulary: str, pattern: str, capacity: int, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = engine(vocabulary, pattern)
        dtype = np.dtype("<u2" if max(enc.n_vocab, end_id + 1) <= 1 << 16 else "<u4")
        system, folder = open_folder(uri)
        system.create_dir(folder, recursive=True)
        file = out = None
        n_rows = 0
        pieces: list[tuple] = []  # (document id as a scalar, piece, start, ids)

        def flush() -> pa.RecordBatch:
            nonlocal file, out, n_rows
            if out is None:
                file = f"tokens-{uuid.uuid4().hex}.bin"
                out = system.open_output_stream(f"{folder}/{file}", compression=None)
            packed = pack_decreasing([len(p[3]) for p in pieces], capacity)
            matrix = np.full((len(packed), capacity), PAD_ID, dtype=dtype)
            for row, members in enumerate(packed):
                at = 0
                for i in members:
                    ids = pieces[i][3]
                    matrix[row, at : at + len(ids)] = ids
                    at += len(ids)
            out.write(matrix.tobytes())
            ends = [np.cumsum([0] + [len(pieces[i][3]) for i in members]).astype(np.int32) for members in packed]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(packed), pa.string()),
                    pa.array(np.arange(n_rows, n_rows + len(packed), dtype=np.int32)),
                    pa.array([dtype.str] * len(packed), pa.string()),
                    pa.array([int(e[-1]) for e in ends], pa.int64()),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                    pa.array([[pieces[i][1] for i in members] for members in packed], pa.list_(pa.int32())),
                    pa.array([[pieces[i][2] for i in members] for members in packed], pa.list_(pa.int64())),
                    pa.array([[pieces[i][0] for i in members] for members in packed], pa.list_(id_type)),
                ],
                names=["file", "row", "dtype", "n_tokens", "cu_seqlens", "position_resets", "pieces", "starts", "ids"],
            )
            n_rows += len(packed)
            pieces.clear()
            return batch

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(enc.encode_to_numpy(text) if text else np.zeros(0, np.uint32), end_id).astype(dtype)
                at = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    pieces.append((doc, k, at, ids[at : at + n]))
                    at += n
                    if len(pieces) >= window:
                        yield flush()
        if pieces:
            yield flush()
        if out is not None:
            out.close()

    return run


def write_token_matrices(
    docs: DataFrame,
    uri: str,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    window: int = WINDOW,
) -> DataFrame:
    """Tokenise, pack and write every whole text; returns an index row per sequence.

    Files under ``uri`` hold rows of ``capacity`` little-endian ids (16 bits
    if the vocabulary allows, else 32), padded with PAD_ID.  The index gives
    ``file``, ``row``, ``dtype``, ``n_tokens``, ``cu_seqlens`` (from 0),
    ``position_resets`` (columns where positions start from 0), the lists
    ``pieces`` and ``starts`` (tokens of the document before the piece) and,
    last, ``<id_col>s``.

    Edge cases: null text counts as empty (its end id alone is packed); null
    or repeated ids and repeated rows are packed row by row; other columns
    are not read; an empty table writes nothing.  Texts of any length are cut
    without loss: full pieces behind a first shorter one.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"{_INDEX}, ids array<{docs.schema[id_col].dataType.simpleString()}>"
    index = written(source.mapInArrow(_write(uri, vocabulary, pattern, capacity, end_id, window), schema), "token-index")
    return index.withColumnRenamed("ids", f"{id_col}s")


def _read(uri: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(uri)
        name, f = None, None
        for b in batches:
            sums = []
            for file, row, dtype, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, system.open_input_file(f"{folder}/{file}")
                kind = np.dtype(dtype)
                f.seek(row * capacity * kind.itemsize)
                ids = np.frombuffer(f.read(n * kind.itemsize), dtype=kind)
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, "ids_crc32"])

    return run


def read_checksums(index: DataFrame, uri: str, capacity: int = CAPACITY) -> DataFrame:
    """The index with ``ids_crc32`` of each sequence as read from its file (as 32-bit ids)."""
    schema = T.StructType([*index.schema.fields, T.StructField("ids_crc32", T.LongType())])
    return index.mapInArrow(_read(uri, capacity), schema)
