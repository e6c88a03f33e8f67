"""kpiforge: a Spark-native sales KPI, data-quality and reporting engine.

One flat ``orders`` table is cleaned (category-median fill, keep-first
de-duplication, negative drop, future-date flag) and summarised into KPI
tables, named SQL views and report tables.  Everything is a lazy
``DataFrame -> DataFrame`` function built on Spark's own operators, so
Catalyst prunes columns, pushes filters into the scan and plans partial
aggregation; nothing is collected to the driver except a few scalar
checks of bounded size.
"""

from kpiforge.schema import ORDERS_SCHEMA, ORDER_COLUMNS

__all__ = ["ORDERS_SCHEMA", "ORDER_COLUMNS"]
