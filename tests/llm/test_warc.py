from __future__ import annotations

import base64
import hashlib
import io
import os

import zstandard

from kpiforge.llm import warc

SCHEMA = "page_id long, url string, html string, file string, frame int, sha string"


def roundtrip(spark, rows, folder, **kw):
    df = spark.createDataFrame([(i, u, h, "f", 0, "s") for i, u, h in rows], SCHEMA).repartition(3)
    index = warc.write_archives(df, folder, **kw)
    return index, warc.read_archives(index, folder)


def brute(rows, least=0):
    groups: dict = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        keep = max(groups[h or ""], key=lambda x: (x is not None, x or 0))
        revisit = len(data) >= least and i != keep
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/é x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c\r\nX: y", "<p>same</p>"), (4, "u", None), (5, "u", ""),
    (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "u", "ü" * 400_000), (8, "u", "ü" * 400_000), (None, "u", "no id"),
    (None, "u", "<p>same</p>"), (9, "u", "repeated"), (9, "u", "repeated"), (10, "u", "own"),
]


def test_round_trip(spark, tmp_path):
    for k, kw in enumerate([{}, {"revisit_bytes": 12}, {"frame_bytes": 1, "bundle_bytes": 1}]):
        _, back = roundtrip(spark, ROWS, f"file://{tmp_path}/{k}", **kw)
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()), key=repr)
        assert got == brute(ROWS, kw.get("revisit_bytes", 0))


def test_index_reaches_single_records(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    index, _ = roundtrip(spark, [(i, "u", f"page {i}" * 50) for i in range(300)], folder, frame_bytes=4000)
    rows = index.collect()
    assert len(rows) == 300 and max(r["frame"] for r in rows) > 3
    for r in rows[::17]:
        fields, block = warc.fetch(folder, r["file"], r["frame"], r["offset"], r["length"])
        assert fields["Page-ID"] == str(r["page_id"])
        assert block.endswith(b"\r\n\r\n" + (f"page {r['page_id']}" * 50).encode())


def test_bundle_is_plain_zstandard_with_a_seek_table(spark, tmp_path):
    roundtrip(spark, [(i, "u", f"page {i}") for i in range(50)], f"file://{tmp_path}/x", frame_bytes=500)
    for name in os.listdir(tmp_path / "x"):
        if not name.endswith(".zst"):
            continue
        data = (tmp_path / "x" / name).read_bytes()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        at, n = 0, 0
        while at < len(plain):
            _, _, at = warc.decode_record(plain, at)
            n += 1
        with warc.fs.LocalFileSystem().open_input_file(str(tmp_path / "x" / name)) as f:
            table = warc.read_seek_table(f)
            assert sum(p for *_, p in table) == len(plain) and n
            assert b"".join(warc.read_frame(f, *t) for t in table) == plain


def test_hot_page(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "the same page" if i % 3 else f"page {i}") for i in range(3000)]
    _, back = roundtrip(spark, rows, f"file://{tmp_path}/x")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark, tmp_path):
    index, back = roundtrip(spark, [], f"file://{tmp_path}/x")
    assert index.count() == 0 and back.count() == 0


def test_bundles_are_read_by_as_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, "u", f"page {i} " * 20) for i in range(400)]
    index, back = roundtrip(spark, rows, f"file://{tmp_path}/x", bundle_bytes=2000, frame_bytes=500)
    files = index.select("file").distinct().count()
    tasks = back.select(F.spark_partition_id().alias("p"), "page_id").select("p").distinct().count()
    assert files >= 8 and tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
