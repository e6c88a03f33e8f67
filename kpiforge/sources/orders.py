"""Readers for the ``orders`` table.

Production reads a flat orders table (Parquet, CSV, catalog table or JDBC)
with the declared schema.  ``conform_test_tables`` builds the same nine
columns from the star-schema test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.operators.joins import broadcast_if, fits_broadcast_all
from kpiforge.operators.partitioning import spread
from kpiforge.schema import ORDER_COLUMNS, ORDERS_SCHEMA, RAW_REVENUE_TYPE
from kpiforge.sinks.files import read_csv


def read_orders(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Read a flat orders table with the declared schema (no inference).

    Parquet files are read with their own schema and checked against the
    declared one, so a wrong type fails fast instead of producing nulls.
    """
    reader = spark.read.options(**(options or {}))
    if fmt == "parquet":
        return _declared(reader.parquet(path))
    if fmt == "csv":
        return read_csv(spark, path, ORDERS_SCHEMA, options)
    # a broken record raises instead of becoming a row of nulls
    return _declared(reader.schema(ORDERS_SCHEMA).option("mode", "FAILFAST").format(fmt).load(path))


def read_orders_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a catalog table holding orders, projected, checked and cast."""
    return _declared(spark.read.table(name))


def _declared(df: DataFrame) -> DataFrame:
    """The nine columns with their declared types (DOUBLE revenue becomes DECIMAL, so sums are exact)."""
    check_schema(df)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in ORDERS_SCHEMA.fields])


def check_schema(df: DataFrame) -> None:
    """Fail fast when a column is missing or has an unexpected type family."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in ORDER_COLUMNS if c not in have]
    if missing:
        raise ValueError(f"orders table lacks columns {missing}")
    for field in ORDERS_SCHEMA.fields:
        got = have[field.name]
        if got.typeName() != field.dataType.typeName() and not (
            field.name == "revenue" and got.typeName() in ("decimal", "double", "float")
        ) and not (field.name == "quantity" and got.typeName() in ("long", "short", "integer")):
            raise ValueError(f"column {field.name}: expected {field.dataType}, got {got}")


# Declared schemas of the star-schema columns used (no footer inference).
STAR_COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_type string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conform_test_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ``orders`` (one row per line item) from the star-schema test tables.

    The fact table (``lineitem``) is always the streamed side.  The
    dimensions are projected to key + attribute, pre-joined at the order
    grain (orders -> customer -> nation -> region, a quarter of the fact's
    rows), and each is broadcast only after a row-count check of its base
    table (all five counted in one job); beyond the bound the join is a
    sort-merge join on its key.  At large scale that is two shuffles of the
    fact (part key, order key) and none for the fixed-size nation/region
    tables.  The part comes first: it adds one column, so the second shuffle
    stays narrow, and after it all lines of an order lie together, so copies
    of an id meet before de-duplication sends its rows anywhere.
    """
    li = spread(
        _table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
            "l_extendedprice", "l_returnflag", "l_linestatus",
        )
    )
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type")

    # Size checks on the base dimensions (plain scans, cheap counts).  A
    # joined dimension has at most as many rows as its driving table,
    # because every join below is on the other table's primary key.
    small = fits_broadcast_all(
        {"region": region, "nation": nation, "customer": customer, "orders": orders, "part": part}
    )
    geo = nation.join(
        broadcast_if(region, small["region"]), nation.n_regionkey == region.r_regionkey
    ).select("n_nationkey", "r_name")
    cust = customer.join(
        broadcast_if(geo, small["nation"]), customer.c_nationkey == geo.n_nationkey
    ).select("c_custkey", "r_name")
    order_dim = orders.join(
        broadcast_if(cust, small["customer"]), orders.o_custkey == cust.c_custkey
    ).drop("c_custkey")
    joined = li.join(broadcast_if(part, small["part"]), li.l_partkey == part.p_partkey).join(
        broadcast_if(order_dim, small["orders"]), li.l_orderkey == order_dim.o_orderkey
    )

    price = F.col("l_extendedprice").cast(RAW_REVENUE_TYPE)
    return joined.select(
        F.concat(
            F.lit("ORD-"), F.col("l_orderkey").cast("string"), F.lit("-"),
            F.col("l_linenumber").cast("string"),
        ).alias("order_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("payment_method"),
        F.when(F.col("l_linestatus") == "F", "Completed")
        .when(F.col("l_returnflag") == "A", "Pending")
        .when(F.col("l_returnflag") == "N", "Cancelled")
        .otherwise("Refunded")
        .alias("status"),
        # planted defects of the fixture: missing and negative revenue
        F.when(F.col("l_partkey") % 67 == 0, F.lit(None).cast(RAW_REVENUE_TYPE))
        .when(F.col("l_partkey") % 211 == 0, -price)
        .otherwise(price)
        .alias("revenue"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("customer_id"),
    )
