from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kpiforge.llm import common
from kpiforge.llm.common import likely_in
from tests.llm import helpers


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(1)
    n = 200
    links = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(n - 1, i) for i in range(n - 1)],
        "random": [(r.randrange(n), r.randrange(n)) for _ in range(120)],
        "none": [(3, 3)],
    }[kind]
    out = common.components(spark.createDataFrame(links, "a long, b long"))
    root = helpers.roots(n, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(map(tuple, out.collect())) == sorted((i, root[i]) for i in linked)


def test_hot_split_join(spark):
    big = spark.createDataFrame([("hot" if i % 2 else f"k{i % 50}", i) for i in range(6000)], "key string, v long")
    keyed = big.groupBy("key").count().withColumnRenamed("count", "rows")
    out = common.hot_split_join(big, keyed, ["key"], "rows", 6000)
    assert out.count() == 6000 and out.filter("key = 'hot'").select("rows").distinct().first()[0] == 3000


def test_added_names_get_out_of_the_way(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    out = common.unboxed(common.boxed(df), df.columns, add={"score": common.F.lit(5)})
    assert out.columns == ["Score", "score_", "score__"]


def test_likely_rows_hold_all_that_are_wanted(spark):
    rows = spark.range(20_000).withColumn("id", F.when(F.col("id") > 5, F.col("id"))).select("id", F.lit("t").alias("text"))
    wanted = spark.createDataFrame([(7,), (19_999,), (40_000,), (None,)], "least long")
    found = [r["id"] for r in likely_in(rows, "id", wanted, "least").collect()]
    assert found.count(None) == 6 and {7, 19_999} <= set(found)
    assert len(found) <= 8 + 3  # hardly any other
    assert likely_in(rows, "id", wanted.limit(0), "least").count() == 0
