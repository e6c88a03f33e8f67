"""Line de-duplication across documents.

Lines are exploded as (document id, 128-bit hash of the normalised line),
once per document; distinct documents per hash are counted by a two-level
aggregate (a hot line is combined on the map side); lines of hashes over
the threshold are dropped everywhere but in the largest document id that
holds them; documents are put together again in line order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import boxed, hot_split_join, prepare, unboxed, written

MIN_CHARS = 20
MIN_DOCS = 3

# Fixed value: the white space that is stripped from a line's ends.
BLANK = b" \t\n\x0b\x0c\r"


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a lower-cased line's key; None if the key is too short to count."""
    key = line.strip(BLANK)
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, digests = [], []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    found = {line_digest(x, min_chars) for x in text.lower().split(b"\n")}
                    found.discard(None)
                    rows += [i] * len(found)
                    digests += found
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                names=["id", "h1", "h2"],
            )

    return run


def _dropper(min_chars: int):
    @F.arrow_udf("struct<text:string,n_dropped:bigint>")
    def run(texts: pa.Array, drops: pa.Array) -> pa.Array:
        values = texts
        n_dropped = np.zeros(len(texts), dtype=np.int64)
        touched = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
        if len(touched):
            changed = texts.to_pylist()
            for i in touched:
                bad = {np.array([d["h1"], d["h2"]], dtype="<i8").tobytes() for d in drops[i].as_py()}
                lines = (changed[i] or "").encode().split(b"\n")
                kept = [x for x in lines if line_digest(x.lower(), min_chars) not in bad]
                n_dropped[i] = len(lines) - len(kept)
                if n_dropped[i]:
                    changed[i] = b"\n".join(kept).decode()
            values = pa.array(changed, pa.string())
        return pa.StructArray.from_arrays([values, pa.array(n_dropped)], names=["text", "n_dropped"])

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share; keep one copy.

    A line's key is the line with ASCII white space stripped at both ends
    and A-Z lower-cased.  Keys of at least ``min_chars`` code points found
    in ``min_docs`` or more documents lose all their lines, except in the
    largest id that holds the key (all its lines there stay).  Returns the
    columns of ``docs`` (text replaced) plus ``n_lines`` (before dropping)
    and ``n_dropped``; a clashing name gets underscores.

    Edge cases: null text stays null and empty text stays empty (both count
    as one empty line); a document that loses all lines gets empty text;
    rows with the same id count as one document; rows with a null id count
    as one document that sorts below all others; repeated rows are kept;
    an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    id_type = docs.schema[id_col].dataType
    hashed = written(
        docs.select(key.alias("id"), text.alias("text")).mapInArrow(
            _hash_lines(min_chars), f"id {id_type.simpleString()}, h1 long, h2 long"
        ),
        "line-hashes",
    )
    per_doc = hashed.select(F.struct("id").alias("doc"), "h1", "h2")
    shared = written(
        per_doc.groupBy("h1", "h2")
        .agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keep"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("n_docs") >= min_docs),
        "shared-lines",
    )
    hits = hot_split_join(per_doc, shared, ["h1", "h2"], "rows", hashed.count())
    drops = (
        hits.filter(F.col("doc") != F.col("keep"))
        .groupBy(F.col("doc")["id"].alias("id"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    )
    whole = boxed(docs, (text_col,), id=key, text=text)
    joined = whole.join(drops.withColumnRenamed("id", "drop_id"), F.col("id").eqNullSafe(F.col("drop_id")), "left")
    done = joined.select("row", "text", _dropper(min_chars)("text", "drops").alias("done"))
    return unboxed(
        done,
        docs.columns,
        {text_col: F.col("done")["text"]},
        {
            "n_lines": F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)).cast("long") + 1,
            "n_dropped": F.col("done")["n_dropped"],
        },
    )
