"""Tolerant input: nothing is lost and nothing is silently null."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from kpiforge.schema import ORDER_COLUMNS, ORDERS_SCHEMA
from kpiforge.session import scratch_path
from kpiforge.sources import quarantine

GOOD = "A,2000-01-02 03:04:05,Books,North,UPI,Completed,12.50,3,C1"


def _line(**fields):
    values = dict(zip(ORDER_COLUMNS, GOOD.split(",")))
    return ",".join({**values, **fields}[c] for c in ORDER_COLUMNS)


def _read(spark, lines, fmt="csv", **options):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    found = quarantine.read_orders_tolerant(spark, path, fmt, options)
    assert found.orders.schema.simpleString() == ORDERS_SCHEMA.simpleString()
    return found.orders.collect(), {r["record"]: r["reason"] for r in found.refused.collect()}


def test_good_missing_and_refused_fields(spark):
    bad = {
        _line(order_date="2000"): "order_date: not a date",
        _line(order_date="2000-13-01"): "order_date: not a date",
        _line(order_date="02/01/2000"): "order_date: not a date",
        _line(revenue="abc"): "revenue: not a number",
        _line(revenue="1.005"): "revenue: more than 2 decimals",
        _line(revenue="1e30"): "revenue: out of range",
        _line(revenue="123456789012345678901.00"): "revenue: out of range",
        _line(quantity="3.5"): "quantity: not an integer",
        _line(quantity="99999999999"): "quantity: out of range",
        _line(order_date="x", revenue="y", quantity="z"): "order_date: not a date; revenue: not a number; quantity: not an integer",
        "A,B": "record: malformed",
        GOOD + ",more,fields": "record: malformed",
        "garbage": "record: malformed",
    }
    good = [GOOD, _line(revenue="", quantity="", order_date=""), _line(revenue=" 7 ", quantity="-1", order_date="2000-01-02"), _line(revenue="1E2"), _line(category='"a, ""b"""')]
    orders, refused = _read(spark, [",".join(ORDER_COLUMNS), "", "  ", *good, *bad])
    assert refused == bad
    assert len(orders) == len(good)
    rows = {(r["revenue"], r["quantity"], r["order_date"], r["category"]) for r in orders}
    day = dt.datetime(2000, 1, 2, 3, 4, 5)
    assert rows == {
        (Decimal("12.50"), 3, day, "Books"), (None, None, None, "Books"), (Decimal("7.00"), -1, dt.datetime(2000, 1, 2), "Books"),
        (Decimal("100.00"), 3, day, "Books"), (Decimal("12.50"), 3, day, 'a, "b"'),
    }


def test_json_lines(spark):
    lines = ['{"order_id": "A", "revenue": "1.50", "quantity": 2}', '{"order_id": "B", "quantity": "two"}', '{"order_id": ', "[]"]
    orders, refused = _read(spark, lines, "json")
    assert [(r["order_id"], r["revenue"], r["quantity"]) for r in orders if r["order_id"]] == [("A", Decimal("1.50"), 2)]
    assert refused[lines[1]] == "quantity: not an integer" and refused[lines[2]] == "record: malformed"


def test_counts_do_not_depend_on_the_columns_that_are_read(spark):
    path = scratch_path(spark, "pruned")
    spark.createDataFrame([(GOOD,), ("A,B",), (_line(revenue="x"),)] * 5, "value string").write.text(path)
    found = quarantine.read_orders_tolerant(spark, path)
    assert (found.orders.count(), found.refused.count(), found.orders.select("order_id").count()) == (5, 10, 5)
    assert [tuple(r) for r in quarantine.refused_summary(found.refused).collect()] == [("record: malformed", 5), ("revenue: not a number", 5)]


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError):
        quarantine.read_texts(spark, "x", "parquet")


def test_batch_job_keeps_refused_records(spark):
    from kpiforge.__main__ import main

    base = scratch_path(spark, "tolerant_job")
    spark.createDataFrame([(_line(order_id=f"O{k}"),) for k in range(5)] + [("A,B",)], "value string").write.text(f"{base}/in")
    paths = main(["--orders", f"{base}/in", "--format", "csv", "--tolerant", "--out", f"{base}/out", "--as-of", "2001-06-15 00:00:00"])
    assert spark.read.parquet(paths["clean_orders"]).count() == 5
    assert [tuple(r) for r in spark.read.parquet(paths["refused"]).collect()] == [("A,B", "record: malformed")]
