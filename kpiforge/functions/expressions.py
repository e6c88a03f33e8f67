"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiforge.schema import CURRENCY


def as_of_literal(as_of: str | dt.datetime | dt.date | None) -> Column:
    """The reporting instant as a ``TIMESTAMP_NTZ`` literal.

    ``None`` means "now" (``current_timestamp``, fixed per query by Spark).
    Passing a value makes results repeatable.
    """
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        text = as_of.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(as_of, dt.date):
        text = as_of.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(as_of)
    return F.lit(text).cast("timestamp_ntz")


def ts_literal(value: str | dt.date | dt.datetime) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (constant-folded, so it pushes into scans)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(value)).cast("timestamp_ntz")


def money(c: Column | str) -> Column:
    """Public money value: decimal rounded half-up to cents, then DOUBLE."""
    return F.round(F.col(c) if isinstance(c, str) else c, 2).cast("double")


def pandas_sum(c: Column | str) -> Column:
    """Sum that is 0 (not NULL) for an empty or all-missing group."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0))


def exact_ratio(num: Column, den: Column, num_scale: int = 0, den_scale: int = 0) -> Column:
    """``num / den`` rounded once, half away from zero, to 2 decimals, as DOUBLE.

    Both sides become integers (``*_scale`` decimal digits each) and are
    divided as integers, so no intermediate rounding can tip a half cent.
    NULL if either is missing or ``den`` is 0.
    """
    n = _whole(num, num_scale) * F.lit(10 ** max(0, den_scale - num_scale)).cast("decimal(6,0)")
    d = _whole(den, den_scale) * F.lit(10 ** max(0, num_scale - den_scale)).cast("decimal(6,0)")
    n2, d2 = F.abs(n) * F.lit(200).cast("decimal(3,0)") + F.abs(d), F.abs(d) * F.lit(2).cast("decimal(1,0)")
    cents = F.call_function("div", n2, d2).cast("double") / F.lit(100.0)
    return F.when(den != 0, F.when((n < 0) != (d < 0), -cents).otherwise(cents) + F.lit(0.0))


def _whole(c: Column, scale: int) -> Column:
    return (c.cast(f"decimal(28,{scale})") * F.lit(10**scale).cast("decimal(6,0)")).cast("decimal(28,0)")


def avg_money(c: Column | str) -> Column:
    """Average of a money column (4 decimal digits at most), rounded once; NULL without values."""
    c = F.col(c) if isinstance(c, str) else c
    return exact_ratio(F.sum(c), F.count(c), num_scale=4)


def pct(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` of counts, rounded once to 2 decimals; NULL if whole is 0."""
    return exact_ratio(part * 100, whole)


def month_text(c: Column | str) -> Column:
    """Month as ``YYYY-MM`` text."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")


def month_start(c: Column | str) -> Column:
    """First instant of the month, kept as ``TIMESTAMP_NTZ``."""
    return F.date_trunc("month", F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def money_text(c: Column, decimals: int) -> Column:
    """``₹1,234,568``: currency sign, thousands separators, half-even digits."""
    return F.concat(F.lit(CURRENCY), F.format_number(c.cast("double"), decimals))


def count_text(c: Column) -> Column:
    """Integer with thousands separators (``12,345``)."""
    return F.format_number(c.cast("long"), 0)


def percent_text(c: Column) -> Column:
    """``10.0%``: the value's shortest decimal text plus a percent sign."""
    return F.concat(c.cast("double").cast("string"), F.lit("%"))


def heading(name: str) -> str:
    """Display heading of a column name: ``order_id`` -> ``Order Id``."""
    return name.replace("_", " ").title()


def stamp_text(as_of, pattern: str = "dd MMM yyyy HH:mm:ss") -> Column:
    """The reporting instant as display text (``15 Jun 2001 00:00:00``)."""
    return F.date_format(as_of_literal(as_of), pattern)
