"""Periodic runs of words inside a document.

A run is a maximal stretch of consecutive words with smallest period ``q``
(words ``q`` apart are identical) that repeats often enough.  All runs of a
text come out of its suffix classes: suffixes are united by decreasing
longest common prefix (Kruskal with union-find over ordered position sets,
the smaller set put into the larger one), and two positions that become
neighbours in a set, at a distance within the prefix they share, seed a run
with that distance as its period.  The first seed of a run gives its start.

A run that counts is first seeded by a prefix of ``least_prefix`` words, so
only positions whose first ``least_prefix`` words occur again in their text
take part; their classes come from prefix doubling over whole blocks of
documents.  A document is handled by one task, whole; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import boxed, prepare, unboxed

MIN_LENGTH, MIN_EXPONENT = 6, 4
# Documents are taken together up to this many words (a longer one is a block of its own).
BLOCK_WORDS = 400_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def least_prefix(min_length: int, min_exponent: int) -> int:
    """Words that the first two periods' suffixes of the shortest run that counts have in common."""
    return max(1, min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1)))


def _repeated(ids: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose next ``depth`` words lie in their document and, by a hash, may occur there again."""
    n = len(ids) - depth + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64)
    for d in range(depth):
        h = (h ^ ids[d : d + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[depth - 1 : depth - 1 + n])
    at = at[np.argsort(h[at], kind="stable")]
    twice = np.zeros(len(at) + 1, dtype=bool)
    twice[1:-1] = h[at][1:] == h[at][:-1]
    return np.sort(at[twice[1:] | twice[:-1]])


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` (first one first) and each element's number of distinct smaller keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def common_prefixes(ids: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order with at least ``depth`` common words: positions, positions, common words.

    The order is one of the trie of suffixes (words in any fixed order);
    a common prefix never leaves the document.
    """
    at = _repeated(ids, doc, depth)
    if not len(at):
        return at, at, at
    n = len(ids)
    padded, owner = np.append(ids, -1), np.append(doc, -1)

    def words(place: np.ndarray) -> list[np.ndarray]:
        """The ``depth`` words from ``place`` on, -1 behind the end of the document."""
        spots = [np.minimum(place + d, n) for d in range(depth)]
        return [np.where(owner[p] == doc[at], padded[p], -1) for p in spots]

    order, rank = _dense([doc[at], *words(at)])
    levels, width = [rank], depth
    index = np.full(n + 1, -1)
    index[at] = np.arange(len(at))
    while rank.max() + 1 < len(at):
        # order by the words that follow, then by their rank; words that are not repeated are like no others
        on = np.minimum(at + width, n)
        order, rank = _dense([rank, *words(at + width), np.where(index[on] >= 0, rank[index[on]], -1 - on)])
        levels.append(rank)
        width *= 2
    x, y = at[order[:-1]], at[order[1:]]
    same = levels[0][order[:-1]] == levels[0][order[1:]]
    x, y = x[same], y[same]
    common = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = index[np.minimum(x + common, n)], index[np.minimum(y + common, n)]
        common += np.where((a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b]), depth << k, 0)
    for _ in range(depth - 1):
        a, b = np.minimum(x + common, n), np.minimum(y + common, n)
        common += (padded[a] == padded[b]) & (owner[a] == owner[x]) & (owner[b] == owner[x])
    return x, y, common


def find_runs(ids: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs of the words ``ids`` of documents ``doc``, in order of start and period."""
    x, y, common = common_prefixes(ids, doc, least_prefix(min_length, min_exponent))
    by_length = np.lexsort((x, -common))
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    seeds: dict[tuple[int, int], int] = {}

    def find(i: int) -> int:
        top = i
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return top

    for i, j, shared in zip(x[by_length].tolist(), y[by_length].tolist(), common[by_length].tolist()):
        a, b = find(i), find(j)
        big, small = places.pop(a, None) or [i], places.pop(b, None) or [j]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        spots = [bisect_left(big, p) for p in small]
        for k, (p, spot) in enumerate(zip(small, spots)):
            # neighbours from the other set only: those of the same set met before
            if spot and (k == 0 or spots[k - 1] != spot) and p - big[spot - 1] <= shared:
                left, period = big[spot - 1], p - big[spot - 1]
                if seeds.get((p + shared, period), left) >= left:
                    seeds[p + shared, period] = left
            if spot < len(big) and (k + 1 == len(spots) or spots[k + 1] != spot) and big[spot] - p <= shared:
                period = big[spot] - p
                if seeds.get((big[spot] + shared, period), p) >= p:
                    seeds[big[spot] + shared, period] = p
        if 4 * len(small) < len(big):
            for p, spot in zip(reversed(small), reversed(spots)):
                big.insert(spot, p)
        else:
            big = sorted(big + small)  # two ascending lists: merged in one go
        places[a] = big
    runs = [(s, e, q) for (e, q), s in seeds.items() if e - s >= max(min_length, min_exponent * q)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _blocks(texts: list):
    """Lists of words of consecutive documents, together about BLOCK_WORDS words."""
    block, size = [], 0
    for t in texts:
        w = t.split() if t else []  # bytes: split at the six ASCII blanks
        if block and size + len(w) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(w)
        size += len(w)
    if block:
        yield block


def _finder(min_length: int, min_exponent: int):
    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def run(texts: pa.Array) -> pa.Array:
        all_runs, collapsed = [], []
        for block in _blocks(texts.cast(pa.binary()).to_pylist()):
            vocabulary: dict[bytes, int] = {}
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for words in block for w in words], dtype=np.int64)
            sizes = np.array([len(words) for words in block])
            begins = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(block)), sizes)
            found: list[list] = [[] for _ in block]
            for s, e, q in find_runs(ids, doc, min_length, min_exponent):
                found[doc[s]].append((s - int(begins[doc[s]]), e - s, q))
            for words, runs in zip(block, found):
                if runs:
                    step = np.zeros(len(words) + 1, np.int64)
                    for s, length, q in runs:
                        step[s + q] += 1
                        step[s + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                all_runs.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                collapsed.append(b" ".join(words))
        return pa.StructArray.from_arrays(
            [
                pa.array(all_runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            names=["runs", "collapsed"],
        )

    return run


def collapse_runs(
    docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """Add ``runs`` (start, length and period in words, by start then period) and ``collapsed`` to each document.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run has at least
    ``min_length`` words and ``min_exponent`` (two or more) periods.
    ``collapsed`` holds the words that no run contains after its first
    period, joined by one space.

    Edge cases: null, empty and blank texts have no runs and collapse to
    empty text; texts of any length are read whole; equal texts get equal
    results and all rows stay; an empty table gives an empty table; extra
    columns stay, a clashing name gets underscores.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    prepare(docs.sparkSession)
    done = _finder(min_length, min_exponent).asNondeterministic()(F.col(f"`{text_col}`").cast("string"))
    return unboxed(boxed(docs, done=done), docs.columns, add={"runs": F.col("done")["runs"], "collapsed": F.col("done")["collapsed"]})
