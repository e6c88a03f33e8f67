"""The ``orders`` data model and the fixed texts of the reports."""

from __future__ import annotations

from pyspark.sql import types as T

# Money is DECIMAL: float sums depend on partition order, decimal sums do not.
RAW_REVENUE_TYPE = T.DecimalType(18, 2)
# After cleaning, a median of two cent values can be a half cent.
CLEAN_REVENUE_TYPE = T.DecimalType(18, 4)

ORDERS_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType(), True),
        T.StructField("order_date", T.TimestampNTZType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("payment_method", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("revenue", RAW_REVENUE_TYPE, True),
        T.StructField("quantity", T.IntegerType(), True),
        T.StructField("customer_id", T.StringType(), True),
    ]
)

ORDER_COLUMNS = [f.name for f in ORDERS_SCHEMA.fields]

# Total order used to decide which copy of an order id survives
# de-duplication: every column, ascending, missing values last.
DEDUP_ORDER = list(ORDER_COLUMNS[1:])


# --- Fixed values: texts and labels that must equal the reference's ---------
COMPLETED = "Completed"
CANCELLED = "Cancelled"
ALL = "All"

# cleaning issue log: (issue type, action) in pipeline order
ISSUE_MISSING = ("Missing Values", "Filled with category median")
ISSUE_DUPLICATES = ("Duplicate Order IDs", "Removed duplicates")
ISSUE_NEGATIVE = ("Negative Revenue", "Removed rows")
ISSUE_FUTURE = ("Future Dates", "Flagged")
ISSUE_FINAL = "Records After Cleaning"
ISSUE_FINAL_ACTION_PREFIX = "Started with "

# data-quality view issue types, in view order
DQ_MISSING_REVENUE = "Missing Revenue"
DQ_DUPLICATE_IDS = "Duplicate Order IDs"
DQ_FUTURE_DATES = "Future Dates"
DQ_NEGATIVE_REVENUE = "Negative Revenue"

# record-count funnel stages
FUNNEL_STAGES = ["Raw Data", "After Dedup", "After Null Fill", "Final Clean"]

# KPI card labels, in card order
KPI_LABELS = [
    "Total Revenue",
    "Total Orders",
    "Avg Order Value",
    "Cancellation Rate",
    "Unique Customers",
    "Completed Orders",
]

CURRENCY = "₹"

# report table headings
HEAD_CATEGORY = ["Category", "Total Orders", "Total Revenue (₹)", "Avg Order Value (₹)", "Units Sold"]
HEAD_TREND = ["Month", "Total Revenue (₹)", "Total Orders"]
HEAD_REGIONAL = ["Region", "Total Orders", "Total Revenue (₹)", "Unique Customers"]
HEAD_QUALITY = ["Issue Type", "Count", "Action Taken"]
# dashboard category table
HEAD_CATEGORY_SCREEN = ["category", "Orders", "Revenue", "AOV", "Units"]

TOP_ORDERS_LIMIT = 10
PREVIEW_LIMIT = 500
DAILY_WINDOW_DAYS = 30
# --- end of fixed values -----------------------------------------------------
