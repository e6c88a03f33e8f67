"""The three states of the orders table (raw, clean, filtered) as one object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.operators import cleaning
from kpiforge.operators.filters import as_date, filter_orders, order_filter
from kpiforge.schema import ORDER_COLUMNS
from kpiforge.session import materialize

MONTH_COLUMN = "order_month"


@dataclass
class FilterSpec:
    """Report filters; ``None``, ``[]`` or a list holding ``All`` mean no filter."""

    date_from: object = None
    date_to: object = None
    categories: list[str] | None = None
    regions: list[str] | None = None
    statuses: list[str] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return filter_orders(
            df, self.date_from, self.date_to, self.categories, self.regions, self.statuses
        )

    def predicate(self):
        """The filter as one Column predicate, or ``None``."""
        return order_filter(
            self.date_from, self.date_to, self.categories, self.regions, self.statuses
        )

    def month_predicate(self):
        """The date range on the ``order_month`` partition column (``YYYY-MM`` text)."""
        preds = []
        if self.date_from is not None:
            preds.append(F.col(MONTH_COLUMN) >= as_date(self.date_from).strftime("%Y-%m"))
        if self.date_to is not None:
            preds.append(F.col(MONTH_COLUMN) <= as_date(self.date_to).strftime("%Y-%m"))
        out = None
        for p in preds:
            out = p if out is None else out & p
        return out


@dataclass
class OrderTables:
    """Raw orders and everything derived from them, built lazily.

    ``materialized=True`` writes the de-duplicated table to the shared
    checkpoint folder once (cutting the lineage): clean orders are a
    filter on it, the issue log counts it, and report queries read Parquet
    files with filter pushdown instead of re-running fill and dedup.
    """

    raw: DataFrame
    as_of: object = None
    filters: FilterSpec = field(default_factory=FilterSpec)
    materialized: bool = False
    median_options: dict = field(default_factory=dict)
    partition_by_month: bool = False
    source: Callable[[], DataFrame] | None = None

    @cached_property
    def medians(self) -> DataFrame:
        return cleaning.category_median(self.raw, **self.median_options)

    @cached_property
    def filled(self) -> DataFrame:
        return cleaning.fill_missing_median(self.raw, self.medians)

    @cached_property
    def stored(self) -> DataFrame:
        """The de-duplicated rows as stored (with ``order_month`` when partitioned)."""
        deduped = cleaning.dedup_orders(self.filled)
        if not self.materialized:
            return deduped
        if self.partition_by_month:
            # range-partition on (date, id): balanced tasks even for a hot date,
            # and each task covers few months, so few files per partition
            laid = deduped.withColumn(
                MONTH_COLUMN, F.date_format("order_date", "yyyy-MM")
            ).repartitionByRange("order_date", "order_id")
            return materialize(laid, "deduped_orders", partition_by=[MONTH_COLUMN])
        # the dedup output is hashed by order_id, so every file spans all
        # dates; sorting each file by date keeps row-group date ranges
        # narrow and date filters skip row groups
        return materialize(deduped, "deduped_orders", sort_within=["order_date"])

    @cached_property
    def deduped(self) -> DataFrame:
        return self.stored.select(*ORDER_COLUMNS) if self.partition_by_month else self.stored

    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.drop_negative(self.deduped)

    @cached_property
    def filtered(self) -> DataFrame:
        if self.materialized and self.partition_by_month:
            month = self.filters.month_predicate()
            stored = self.stored if month is None else self.stored.where(month)
            return self.filters.apply(cleaning.drop_negative(stored)).select(*ORDER_COLUMNS)
        return self.filters.apply(self.clean)

    @cached_property
    def issues(self) -> DataFrame:
        return cleaning.issue_log(self.raw, self.deduped, self.as_of)

    def reload(self) -> "OrderTables":
        """A fresh, lazy copy over what ``source`` reads now.

        The "refresh data" action: nothing is cached by these tables, so
        reading the source anew (which lists its files again) is all there
        is to do, and other frames of the session are left alone.
        """
        raw = self.source() if self.source else self.raw
        return OrderTables(
            raw, self.as_of, self.filters, self.materialized, dict(self.median_options),
            self.partition_by_month, self.source,
        )

    @cached_property
    def funnel(self) -> DataFrame:
        return cleaning.record_funnel(self.raw, self.deduped, self.filters.predicate())
