"""Byte-level BPE and packed token matrices."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from kpiforge.llm import bpe, token_output
from kpiforge.llm.tokens import engine, read_ranks
from tests.llm import helpers

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "\n\n \t x"), (5, "don't   stop  é 😀‍�"), (6, "<|endoftext|>"), (7, "a" * 5000),
    (8, helpers.prose(1, 20_000)), (None, "no id"), (9, "again and again"), (9, "again and again"), (10, "٣٤ १२ Ⅷ ½ ß 漢字かな"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", [1]) for i, t in rows], "doc_id long, text string, chunk string, ids array<int>").repartition(3)


def reference():
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    return lambda t: enc.encode_ordinary(t or "")


def test_vocabulary_files_agree():
    assert read_ranks(JSON) == read_ranks(RANKS)
    tok, enc = Tokenizer.from_file(JSON), engine(JSON, P.PATTERN)
    tok.encode_special_tokens = True
    for _, t in TEXTS:
        assert enc.encode_ordinary(t or "") == tok.encode(t or "", add_special_tokens=False).ids


def test_encode_decode(spark):
    of = reference()
    for chunk_bytes in (1, 1 << 20):
        out = bpe.decode(bpe.encode(frame(spark, TEXTS), RANKS, P.PATTERN, chunk_bytes=chunk_bytes), RANKS)
        got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["data"]).decode()) for r in out.collect()), key=repr)
        assert got == sorted(((i, of(t), t or "") for i, t in TEXTS), key=repr)


def test_digests(spark):
    of = reference()
    want = [(i, len(of(t)), hashlib.sha256(" ".join(map(str, of(t))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS]
    got = [tuple(r) for r in bpe.digests(frame(spark, TEXTS), RANKS, P.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.digests(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_decode_nulls_and_clash(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [15496], "z")], "k int, ids array<int>, data string")
    rows = {r["k"]: r["data_"] for r in bpe.decode(df, RANKS).collect()}
    assert rows[1] is None and bytes(rows[2]) == b"" and bytes(rows[3]) == b"Hello"


def test_capacity_tree():
    r = np.random.default_rng(0)
    tree, have = token_output.CapacityTree(100), []
    for _ in range(2000):
        if have and r.random() < 0.4:
            room = have.pop(int(r.integers(len(have))))
            tree.add(room, -1)
        else:
            have.append(int(r.integers(0, 101)))
            tree.add(have[-1], 1)
        need = int(r.integers(0, 101))
        assert tree.least_from(need) == min([h for h in have if h >= need], default=-1)


def test_pack_decreasing_is_best_fit():
    r = np.random.default_rng(1)
    for sizes in (r.integers(1, 65, 500).tolist(), [64, 64], [1], [], [30] * 20):
        rows = token_output.pack_decreasing(sizes, 64)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in row) <= 64 for row in rows)
        assert len(rows) == helpers.best_fit_decreasing(sizes, 64)


def test_matrices(spark, tmp_path):
    of = reference()
    folder = f"file://{tmp_path}/m"
    index = token_output.write_token_matrices(frame(spark, TEXTS), folder, JSON, P.PATTERN, capacity=128, window=7)
    assert index.columns[-1] == "doc_ids"
    pieces = []
    for r in token_output.read_checksums(index, folder, 128).collect():
        data = np.fromfile(tmp_path / "m" / r["file"], dtype=r["dtype"]).reshape(-1, 128)[r["row"]]
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 128 and r["position_resets"] == cu[:-1]
        assert zlib.crc32(data[: cu[-1]].astype("<u4").tobytes()) == r["ids_crc32"]
        assert (data[cu[-1] :] == token_output.PAD_ID).all()
        pieces += [(i, k, s, data[a:z].tolist()) for i, k, s, a, z in zip(r["doc_ids"], r["pieces"], r["starts"], cu, cu[1:])]
    want = []
    for i, t in TEXTS:
        ids, at = of(t) + [2], 0
        for k, n in enumerate(token_output.cut(len(ids), 128)):
            want.append((i, k, at, ids[at : at + n]))
            at += n
    assert sorted(pieces, key=repr) == sorted(want, key=repr)
    empty = token_output.write_token_matrices(frame(spark, []), folder, JSON, P.PATTERN)
    assert token_output.read_checksums(empty, folder).count() == 0
