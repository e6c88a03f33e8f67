from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kpiforge.llm import best_fit
from tests.llm import helpers

JSON = public_tokenizers.path("byte_bpe_50k.json")


def packed(spark, sizes, capacity=64, rows=50, monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr(best_fit, "ROWS_PER_PARTITION", rows)
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, size int")
    out = {r["uid"]: (r["sequence_id"], r["offset"]) for r in best_fit.pack(df, capacity).collect()}
    assert sorted(out) == list(range(len(sizes)))
    rooms: dict = {}
    for uid, (seq, offset) in out.items():
        rooms.setdefault(seq, []).append((offset, int(sizes[uid])))
    for parts in rooms.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(rooms)


@pytest.mark.parametrize("kind", ["uniform", "small", "tiny", "same", "skewed"])
def test_close_to_best_fit_decreasing(spark, monkeypatch, kind):
    r = np.random.default_rng(5)
    sizes = {
        "uniform": r.integers(1, 65, 600),
        "small": r.integers(1, 20, 600),
        "tiny": r.integers(1, 3, 600),
        "same": np.full(400, 19),
        "skewed": np.minimum(64, 1 + r.exponential(15, 600).astype(int)),
    }[kind]
    n = packed(spark, sizes, monkeypatch=monkeypatch)
    assert n <= 1.03 * helpers.best_fit_decreasing(sizes.tolist(), 64) + 1


def test_pack_edge_cases(spark):
    assert packed(spark, []) == 0
    assert packed(spark, [64, 64]) == 2
    assert packed(spark, [1]) == 1
    assert packed(spark, [32, 32, 33, 31]) == 2


def test_sweep_gives_the_smallest_gap_that_fits():
    # sizes, largest first: gaps 9, 7; item 6; gap 5; items 5, 4; gap 3
    mate, free = best_fit.match_in_order(np.array([False, False, True, False, True, True, False]))
    assert mate.tolist() == [-1, -1, 1, -1, 3, 0, -1]
    assert free.tolist() == [False, False, False, False, False, False, True]
    mate, free = best_fit.match_in_order(np.array([True, False, True, True]))
    assert mate.tolist() == [-1, -1, 1, -1] and free.tolist() == [True, False, False, True]


def test_left_over_counts_match_across_partitions():
    segments, taken, gaps = best_fit._across({0: (1, 2), 1: (0, 3), 2: (4, 1)})
    assert segments == [(2, 0, 3, 1, 2), (2, 3, 4, 0, 1)]
    assert taken == {0: 0, 1: 0, 2: 4} and gaps == {0: 1, 1: 0, 2: 1}


def test_cut():
    assert best_fit.cut(10, 10) == [10] and best_fit.cut(25, 10) == [5, 10, 10] and best_fit.cut(20, 10) == [10, 10]


def test_documents(spark):
    texts = [None, "", "a", helpers.prose(1, 30_000), helpers.prose(2, 900), "same text", "same text", "<|endoftext|> é\n\t 😀", None]
    ids = [1, 2, 3, 4, None, 6, 6, 8, None]
    df = spark.createDataFrame([(i, t, "c", 1.5) for i, t in zip(ids, texts)], "doc_id long, text string, length string, uid double")
    out = best_fit.pack_documents(df, JSON, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = []
    for i, t in zip(ids, texts):
        x, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, n in enumerate(best_fit.cut(len(x), 1024)):
            want.append((i, k, at, n, zlib.crc32(x[at : at + n].tobytes())))
            at += n
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    rooms: dict = {}
    for r in rows:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in rooms.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
    assert len(rooms) == helpers.best_fit_decreasing([n for *_, n, _ in want], 1024)
    assert best_fit.pack_documents(df.limit(0), JSON, public_tokenizers.PATTERN).count() == 0
