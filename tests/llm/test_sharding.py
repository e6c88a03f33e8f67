from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from kpiforge.llm import sharding

SCHEMA = "doc_id long, text string, shard string, bucket int, SLOT string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def test_slots_sizes_and_growth(spark):
    rows = [(i, f"text {i} é" * (i % 5)) for i in range(2000)] + [(None, None), (None, ""), (7, "again"), (7, "again")]
    rows += [(10**6, "hot id")] * 900
    out = sharding.shard_rows(frame(spark, rows), 16).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr
    )
    by_shard, by_id = {}, {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert set(by_shard) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(x) == 1 for x in by_id.values())
    moved = sum(a != b for x in by_id.values() for a, b in x)
    assert 0.6 / 17 < moved / len(by_id) < 1.6 / 17


def test_growth_equals_a_run_with_one_more_shard(spark):
    df = frame(spark, [(i, "x") for i in range(500)])
    grown = {r["doc_id"]: r["grown_shard"] for r in sharding.shard_rows(df, 4).collect()}
    assert grown == {r["doc_id"]: r["shard"] for r in sharding.shard_rows(df, 5).collect()}


def test_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    n = Counter(r["shard"] for r in sharding.assign(df, "k", [1.0, 3.0, 0.0, 2.0]).collect())
    assert n[2] == 0 and all(abs(n[s] / 20_000 - w / 6) < 0.015 for s, w in ((0, 1), (1, 3), (3, 2)))


def test_empty_and_clash(spark):
    df = frame(spark, [])
    assert sharding.shard_rows(df, 16).count() == 0
    out = sharding.assign(frame(spark, [(1, "a")]), "doc_id", [1.0, 1.0])
    assert out.columns == ["doc_id", "text", "shard", "bucket", "SLOT", "shard_"]


def test_native_plan(spark, capsys):
    sharding.shard_rows(frame(spark, [(1, "a")]), 16).explain()
    assert "Python" not in capsys.readouterr().out


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), "doc_id", [1.0] * 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {r["doc_id"]: r["shard"] for r in sharding.assign(df, "doc_id", [1.0] * 4).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want
