from __future__ import annotations

import math
import random

import numpy as np
import pytest

from kpiforge.llm import vector_codes
from kpiforge.llm.registry import QUERIES
from tests.conftest import SF_TINY


def brute(rows, parts=8, entries=16, rounds=6):
    """``rows``: (id, vector, label); the same rounds by plain loops."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    if not first:
        return []
    dim = len(first[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    ends = [dim * i // parts for i in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(ends, ends[1:])]
    books = [[cut(v)[p] for _, v, _ in first if len(v) == dim] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = {}
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                found.setdefault((p, near(p, x)[1]), []).append(x)
        for (p, k), xs in found.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, lab in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    totals = {}
    for _, _, e, lab in out:
        totals[lab] = totals.get(lab, 0) + e
    return sorted(((i, c, e, totals[lab]) for i, c, e, lab in out), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return vector_codes.compress(df, **how)


def check(spark, rows, **how):
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in run(spark, rows, **how).collect()), key=repr)
    assert got == brute(rows, **how)
    return got


def vectors(seed, n, dim=16, spread=1.0):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(dim)], r.choice([None, 1, 2])) for i in range(n)]


def test_random_vectors_against_plain_loops(spark):
    check(spark, vectors(1, 150))
    check(spark, vectors(2, 60, dim=13), parts=5, entries=7, rounds=3)  # unequal parts


def test_ties_copies_and_few_vectors(spark):
    r = random.Random(5)
    rows = [(i // 2, [float(r.randint(-2, 2)) / 4096 for _ in range(16)], 1) for i in range(120)]
    check(spark, rows)  # many equal distances and repeated ids
    check(spark, [(1, [0.5] * 8, None)] * 40)
    check(spark, vectors(3, 5))  # fewer vectors than entries


def test_unusable_vectors_are_dropped(spark):
    rows = vectors(7, 40)
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, None)]
    rows += [(None, [0.25] * 16, 1), (104, [], 1), (105, [1.0, 2.0], 2), (0, [None] + [0.0] * 15, 2)]
    check(spark, rows)


def test_empty_tables_and_empty_vectors(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [(1, None, 1), (2, [float("nan")], None)]).collect() == []
    assert [(r["code"], r["error"]) for r in run(spark, [(1, [], 1)]).collect()] == [("00" * 8, 0)]


def test_columns_stay_and_clashes_are_renamed(spark):
    df = spark.createDataFrame(
        [(i, [float(i)] * 8, 1, "c", "k", "d") for i in range(4)], "vec_id long, embedding array<float>, label int, code string, key string, done string"
    )
    out = vector_codes.compress(df)
    assert out.columns == ["vec_id", "label", "code", "key", "done", "code_", "error", "label_error", "codebooks_sha256"]
    assert {(r["code"], r["key"], r["done"]) for r in out.collect()} == {("c", "k", "d")}


def test_masks_find_the_nearest_entry_with_more_than_one_word(spark):
    rng = np.random.default_rng(4)
    for k, width in [(1, 1), (70, 3), (130, 2), (64, 8)]:
        entries = rng.integers(-5, 6, (k, width))
        x = rng.integers(-8, 9, (400, width))
        best, far = vector_codes.Slices(entries).nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (far == every.min(axis=1)).all() and (best == every.argmin(axis=1)).all()


def test_codes_are_decoded_to_their_entries(spark):
    df = spark.createDataFrame(vectors(9, 50), "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit_codebooks(df)
    out = vector_codes.decode(vector_codes.encode(df, books), books)
    true = {r["vec_id"]: [math.floor(4096 * x) for x in r["embedding"]] for r in df.collect()}
    for r in out.collect():
        assert sum((round(4096 * a) - b) ** 2 for a, b in zip(r["embedding"], true[r["vec_id"]])) == r["error"]


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="are not supported"):
        run(spark, [(1, [1e30] * 8, 1)])


def test_registered_query_against_plain_loops(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF_TINY}/embeddings.parquet").collect()]
    out = QUERIES["op12_vector_codes"](spark, SF_TINY)
    assert out.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=repr) == brute(rows)
