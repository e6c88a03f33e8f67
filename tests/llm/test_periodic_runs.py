from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiforge.llm import periodic_runs
from kpiforge.llm.registry import QUERIES
from tests.conftest import SF_TINY


def brute(w, min_length=6, min_exponent=4):
    """Stretches of every distance; those inside a stretch of a smaller period go."""
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i == s:
                i += 1
                continue
            e = i + q
            if e - s >= max(min_length, min_exponent * q) and not any(a <= s and b >= e and p < q for a, b, p in out):
                out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in periodic_runs.collapse_runs(df, **how).collect()}


def check(spark, texts, **how):
    got = run(spark, texts, **how)
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        want = brute(w, **how)
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in got[i]["runs"]] == want
        assert got[i]["collapsed"] == brute_collapse(w, want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=4), st.sampled_from([(6, 4), (4, 2), (10, 3), (2, 2), (9, 4)]))
def test_runs_of_several_documents_against_brute_force(docs, bounds):
    ids = np.array([x for w in docs for x in w], dtype=np.int64)
    sizes = [len(w) for w in docs]
    doc, begins = np.repeat(np.arange(len(docs)), sizes), np.cumsum([0, *sizes])
    want = [(s + begins[d], e + begins[d], q) for d, w in enumerate(docs) for s, e, q in brute(w, *bounds)]
    assert periodic_runs.find_runs(ids, doc, *bounds) == sorted(want, key=lambda r: (r[0], r[2]))


def test_edge_cases(spark):
    check(
        spark,
        [
            None, "", " \t\n\x0b\x0c\r", "one", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b",
            "x " + "a b c " * 4 + "a y", "a b " * 4 + "c " + "a b " * 4, "é é é é é é é", "a a " * 9,
            "a a a a a a b b b b b b", "a a a a a a b " * 4, "A a " * 5,
        ],
    )
    assert run(spark, [None])[0]["collapsed"] == ""


def test_random_and_planted_periods(spark):
    r = random.Random(3)
    texts = []
    for _ in range(150):
        w = [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 200))]
        if w and r.random() < 0.6:
            a, p = r.randrange(len(w)), r.randint(1, 9)
            w = [w[i] if i < a else w[min(len(w) - 1, a + (i - a) % p)] for i in range(len(w))]
        texts.append(" ".join(w))
    check(spark, texts + texts[:20])
    check(spark, texts, min_length=4, min_exponent=2)


def test_very_long_text(spark):
    words = [f"w{i * i % 977}" for i in range(30_000)]
    long = " ".join(words) + " " + "again and again " * 20_000 + " ".join(f"z{i}" for i in range(30_000)) + " same" * 30_000
    got = run(spark, [long, "a " * 7])
    assert [(r["start"], r["length"], r["period"]) for r in got[0]["runs"] if r["start"] >= 29_990] == [(30_000, 60_000, 3), (120_000, 30_000, 1)]
    assert [(r["start"], r["length"], r["period"]) for r in got[1]["runs"]] == [(0, 7, 1)]


def test_columns_stay_and_clashes_are_renamed(spark):
    df = spark.createDataFrame([(1, "a " * 8, "r", "c")], "doc_id long, text string, runs string, Collapsed string")
    out = periodic_runs.collapse_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "Collapsed", "runs_", "collapsed_"]
    row = out.first()
    assert (row["runs"], row["Collapsed"], row["collapsed_"]) == ("r", "c", "a")
    assert periodic_runs.collapse_runs(df.limit(0)).collect() == []


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(spark.createDataFrame([], "text string"), min_exponent=1)


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_registered_query_against_brute_force(spark):
    out = QUERIES["op11_periodic_runs"](spark, SF_TINY)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [
        ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    rows = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    seen = 0
    for doc_id, text in rows:
        w = planted(doc_id, text)
        if len(w) > 1500:
            continue
        runs = brute(w)
        seen += len(runs)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        digests = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapse(w, runs)))
        assert got[doc_id] == (doc_id, len(runs), *top, *digests)
    assert seen
