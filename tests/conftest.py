from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from kpiforge.session import build_session

    session = build_session(master="local[*]", shuffle_partitions=8, app_name="kpiforge-tests")
    yield session
    session.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def order(
    order_id="ORD-1",
    date="2000-01-10 00:00:00",
    category="Books",
    region="North",
    payment="UPI",
    status="Completed",
    revenue="10.00",
    quantity=1,
    customer="CUST-1",
):
    """One row of the orders schema (strings for money, ISO text for dates)."""
    return (
        order_id,
        ts(date) if date is not None else None,
        category,
        region,
        payment,
        status,
        Decimal(revenue) if revenue is not None else None,
        quantity,
        customer,
    )


def orders_df(spark, rows):
    from kpiforge.schema import ORDERS_SCHEMA

    return spark.createDataFrame(rows, ORDERS_SCHEMA)
