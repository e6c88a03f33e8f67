"""Byte-level BPE over distinct words.

Texts are split into pre-tokens with positions, in chunks of documents; a
chunk's distinct words are dealt by a hash over the cluster, so each distinct
word is encoded once, whatever the number of its uses.  The ids are joined
back to the chunk, which puts its documents together by position.  Decoding
joins ids with the token-byte table.

What is exploded, shuffled and joined back travels as compressed blocks, one
for each chunk and word bucket, since a row for each use of a word would
shuffle several times the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kpiforge.llm.common import prepare, worker_cache
from kpiforge.llm.tokens import engine, read_ranks

# Text that a chunk holds; bounds the memory of a task beside a single text.
CHUNK_BYTES = 8 << 20


def pack_list(items: list[bytes]) -> bytes:
    """A list of byte strings as one compressed block."""
    lengths = np.array([len(x) for x in items], dtype="<u4")
    return zstandard.compress(np.array([len(items)], "<u4").tobytes() + lengths.tobytes() + b"".join(items), 3)


def unpack_list(block: bytes) -> list[bytes]:
    data = zstandard.decompress(block)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [data[a:z] for a, z in zip(starts.tolist(), ends.tolist())]


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4")


def _splitter(pattern: str):
    import regex

    cache = worker_cache()
    if ("split", pattern) not in cache:
        cache["split", pattern] = regex.compile(pattern)
    return cache["split", pattern]


# ``at``: the chunk's number for its documents, -1 - bucket for its words
_CHUNKS = "at long, chunk long, block binary, wide boolean, counts binary"


def _explode(pattern: str, buckets: int, chunk_bytes: int):
    """Rows of two kinds per chunk: its documents, and its distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(pattern).findall
        part, n_chunks, id_type = TaskContext.get().partitionId(), 0, None
        ids, counts, numbers, words, size = [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            nonlocal n_chunks, size
            chunk = (part << 33) + n_chunks
            every = [w.encode() for w in words]
            home = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in every], dtype=np.int64)
            order = np.argsort(home, kind="stable")
            place = np.empty(len(every), dtype=np.int64)
            place[order] = np.arange(len(every))
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            blocks = [pack_list([every[i] for i in order[cuts[k] : cuts[k + 1]]]) for k in used]
            flat = _small(place[np.array(numbers, dtype=np.int64)] if numbers else np.zeros(0, np.int64))
            n = 1 + len(used)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk, *(-1 - used).tolist()], pa.int64()),
                    pa.array(np.full(n, chunk)),
                    pa.array([zstandard.compress(flat.tobytes(), 3), *blocks], pa.binary()),
                    pa.array([flat.itemsize == 4] + [None] * len(used), pa.bool_()),
                    pa.array([np.array(counts, "<u4").tobytes()] + [None] * len(used), pa.binary()),
                    pa.array([ids] + [None] * len(used), pa.list_(id_type)),
                ],
                names=["at", "chunk", "block", "wide", "counts", "ids"],
            )
            n_chunks += 1
            size = 0
            for x in (ids, counts, numbers, words):
                x.clear()
            return out

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split(text) if text else []
                ids.append(doc)
                counts.append(len(found))
                for w in found:
                    k = words.get(w)
                    if k is None:
                        k = words[w] = len(words)
                    numbers.append(k)
                size += len(text or "")
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    return run


def _encode(vocabulary: str, pattern: str):
    """Ids of the words of each block; a word that several chunks use is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = engine(vocabulary, pattern)
        known: dict[bytes, bytes] = {}
        for b in batches:
            b = b.filter(pa.compute.less(b.column(0), 0))  # the documents' rows are for the assembly
            blocks = []
            for block in b.column(2).to_pylist():
                out = []
                for w in unpack_list(block):
                    code = known.get(w)
                    if code is None:
                        code = known[w] = np.array(enc._encode_single_piece(w), dtype="<u4").tobytes()
                    out.append(code)
                blocks.append(pack_list(out))
            buckets = -1 - b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(buckets), pa.array(blocks, pa.binary())], names=["at", "bucket", "codes"])

    return run


def _assemble(vocabulary: str, digest: bool, id_type: pa.DataType):
    digests = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    empty = pa.schema([("id", id_type), *(digests if digest else [("ids", pa.list_(pa.int32()))])])

    def run(docs: pa.Table, codes: pa.Table) -> pa.Table:
        """Documents of one chunk from their word numbers and the words' ids."""
        if docs.column("at")[0].as_py() < 0:
            return empty.empty_table()  # rows of words
        order = np.argsort(codes.column("bucket").to_numpy(), kind="stable")
        blocks = codes.column("codes").to_pylist()
        ids = [np.frombuffer(c, "<u4") for i in order for c in unpack_list(blocks[i])]
        numbers = np.frombuffer(zstandard.decompress(docs.column("block")[0].as_py()), "<u4" if docs.column("wide")[0].as_py() else "<u2")
        ends = np.cumsum(np.frombuffer(docs.column("counts")[0].as_py(), "<u4"), dtype=np.int64)
        names = docs.column("ids")[0].values
        spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        if not digest:
            flat = [np.concatenate([ids[k] for k in numbers[a:z].tolist()] or [np.zeros(0, "<u4")]) for a, z in spans]
            return pa.table({"id": names, "ids": pa.array([x.astype(np.int32) for x in flat], pa.list_(pa.int32()))})
        table = token_bytes(vocabulary)
        said = [b" ".join(b"%d" % t for t in x.tolist()) for x in ids]
        back = [b"".join([table[t] for t in x.tolist()]) for x in ids]
        sizes = np.array([len(x) for x in ids] or [0], dtype=np.int64)
        n, one, other = [], [], []
        for a, z in spans:
            use = numbers[a:z]
            n.append(int(sizes[use].sum()) if z > a else 0)
            use = use.tolist()
            one.append(hashlib.sha256(b" ".join([said[k] for k in use])).hexdigest())
            other.append(hashlib.sha256(b"".join([back[k] for k in use])).hexdigest())
        return pa.table({"id": names, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": one, "decoded_sha256": other})

    return run


def token_bytes(vocabulary: str) -> dict[int, bytes]:
    """The token-byte table, whose size is the vocabulary's; read once per worker process."""
    cache = worker_cache()
    if ("bytes", vocabulary) not in cache:
        cache["bytes", vocabulary] = {i: t for t, i in read_ranks(vocabulary).items()}
    return cache["bytes", vocabulary]


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, digest: bool, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # One exchange deals documents by chunk and words by bucket; both branches below read it, so texts are
    # split once and word numbers are shuffled once.  No filter stands over it: it would be pushed below
    # and make two exchanges of it.
    dealt = source.mapInArrow(_explode(pattern, buckets, chunk_bytes), f"{_CHUNKS}, ids array<{id_type}>").repartition(buckets, "at")
    codes = dealt.mapInArrow(_encode(vocabulary, pattern), "at long, bucket long, codes binary")
    out = f"id {id_type}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    assemble = _assemble(vocabulary, digest, to_arrow_type(docs.schema[id_col].dataType))
    done = dealt.groupBy("at").cogroup(codes.groupBy("at")).applyInArrow(assemble, out)
    return done.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Token ids of every whole text: the id column and ``ids``.

    Each match of ``pattern`` is encoded by itself; there are no special
    tokens.  Edge cases: null and empty texts have no ids; null or repeated
    ids and repeated rows give a row each; other columns are not read; texts
    of any length are encoded whole; an empty table gives an empty table.
    """
    return _encoded(docs, vocabulary, pattern, id_col, text_col, False, chunk_bytes)


def _decode(vocabulary: str):
    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        table = token_bytes(vocabulary)
        return pa.array([None if x is None else b"".join([table[t] for t in x]) for x in ids.to_pylist()], pa.binary())

    return run


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``data``, the bytes of its ids (null for null ids; unknown ids raise)."""
    name = "data"
    while name.lower() in {c.lower() for c in encoded.columns}:
        name += "_"
    return encoded.withColumn(name, _decode(vocabulary)(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """As ``encode``, but only counts and digests of the ids and of the bytes they decode to."""
    return _encoded(docs, vocabulary, pattern, id_col, text_col, True, chunk_bytes)
