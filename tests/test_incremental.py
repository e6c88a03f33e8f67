"""The incremental refresh equals a rebuild from all rows, whatever order they arrive in."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import cleaning
from kpiforge.plans import views
from kpiforge.plans.tables import OrderTables
from kpiforge.session import materialize, scratch_path
from kpiforge.sinks.versions import read_pointer
from kpiforge.sources.orders import conform_test_tables
from kpiforge.streaming import incremental, keyed_store, value_histogram
from kpiforge.streaming.incremental import apply_batch, incremental_tables
from kpiforge.streaming.keyed_store import KeyedStore
from tests.conftest import SF_TINY, order, orders_df

AS_OF = "2001-06-15 12:00:00"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _check(spark, out, raw, as_of=AS_OF):
    t = OrderTables(raw, as_of=as_of)
    got = incremental_tables(spark, out)
    want = views.build_views(t.raw, t.clean, as_of) | {"issue_log": t.issues, "category_median": t.medians}
    for name, df in want.items():
        assert _rows(got[name]) == _rows(df), name


def _random_orders(seed, n, negative=False):
    """Few ids, days and amounts: many copies that agree up to revenue, missing values everywhere."""
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    out = []
    for _ in range(n):
        category = pick("A", "B", "C", None)
        money = None if r.random() < 0.3 else f"{r.choice([-5, 1, 2, 3, 50, 50, 80])}.{r.randint(0, 3)}0"
        if negative and category == "B" and money is not None:
            money = "-" + money.lstrip("-")
        out.append(
            order(
                pick(None, *[f"O{k}" for k in range(n // 3)]),
                pick(None, "2001-06-01 00:00:00", "2001-06-15 00:00:00", "2001-06-15 18:00:00", "2001-07-01 00:00:00"),
                category, pick("N", "S", None), pick("card", "cash"), pick("Completed", "Completed", "Cancelled", None),
                money, pick(None, 1, 2), pick(None, *[f"C{k}" for k in range(6)]),
            )
        )
    return out


@pytest.mark.parametrize("seed, negative", [(1, False), (2, True)])
def test_shuffled_arrivals_equal_a_rebuild_after_every_batch(spark, seed, negative):
    rows = _random_orders(seed, 150, negative)
    out = scratch_path(spark, "shuffled")
    cuts = [0, 50, 60, 150]
    for epoch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        apply_batch(orders_df(spark, rows[a:b]), epoch, out, as_of=AS_OF)
        if epoch:
            _check(spark, out, orders_df(spark, rows[:b]))


def test_test_tables_in_file_order(spark):
    raw = materialize(conform_test_tables(spark, SF_TINY), "natural")
    got = incremental.refresh_incremental_once(spark, [raw.orderBy(F.col("order_date").desc())], files=3, as_of=AS_OF)
    t = OrderTables(raw, as_of=AS_OF)
    for name, df in views.build_views(t.raw, t.clean, AS_OF).items():
        assert _rows(got[name]) == _rows(df), name
    assert _rows(got["issue_log"]) == _rows(t.issues)


def test_an_earlier_copy_takes_the_kept_one_back(spark):
    out = scratch_path(spark, "taken_back")
    late = [order("A", "2001-03-01 00:00:00", region="South", customer="X", revenue="90.00"), order("B")]
    early = [order("A", "2001-02-01 00:00:00", region="North", customer="Y", revenue="10.00")]
    apply_batch(orders_df(spark, late), 0, out, as_of=AS_OF)
    apply_batch(orders_df(spark, early), 1, out, as_of=AS_OF)
    _check(spark, out, orders_df(spark, late + early))
    assert {r["region"] for r in incremental_tables(spark, out)["vw_regional_sales"].collect()} == {"North"}


def test_a_moving_median_settles_contested_ids_anew(spark):
    """Two copies differ only in revenue, one has none: which one is kept depends on the median."""
    out = scratch_path(spark, "contested")
    same = [order("A", revenue="20.00", customer="X"), order("A", revenue=None, customer="Y")]
    batches = [same + [order("L", revenue="5.00")], [order(f"M{k}", revenue="70.00") for k in range(6)], [order(f"N{k}", revenue="1.00") for k in range(20)]]
    rows, kept = [], []
    for epoch, b in enumerate(batches):
        rows += b
        apply_batch(orders_df(spark, b), epoch, out, as_of=AS_OF)
        _check(spark, out, orders_df(spark, rows))
        kept += [r["customer_id"] for r in OrderTables(orders_df(spark, rows), as_of=AS_OF).clean.where("order_id = 'A'").collect()]
    assert kept == ["Y", "X", "Y"]  # the copy without revenue, the other one, and back


def test_the_top_reserve_is_refilled(spark, monkeypatch):
    monkeypatch.setattr(incremental, "RESERVE", 12)
    out = scratch_path(spark, "reserve")
    rows = [order(f"O{k:02}", "2001-03-01 00:00:00", revenue=f"{100 + k}.00") for k in range(40)]
    apply_batch(orders_df(spark, rows), 0, out, as_of=AS_OF)
    # the best ones lose their revenue to earlier copies
    back = [order(f"O{k:02}", "2001-01-01 00:00:00", revenue="1.00") for k in range(32, 40)]
    apply_batch(orders_df(spark, back), 1, out, as_of=AS_OF)
    _check(spark, out, orders_df(spark, rows + back))
    more = [order(f"P{k}", "2001-03-01 00:00:00", revenue=f"{k}.50") for k in range(30)] + [order("Q", revenue=None)]
    apply_batch(orders_df(spark, more), 2, out, as_of=AS_OF)
    _check(spark, out, orders_df(spark, rows + back + more))


def test_a_state_without_values_asks_for_its_median_table(spark):
    base = scratch_path(spark, "given")
    spark.sql("SELECT 'Books' AS category, CAST(7 AS DECIMAL(18,4)) AS median_revenue").write.parquet(f"{base}/medians")
    apply_batch(orders_df(spark, [order("A", revenue=None)]), 0, f"{base}/out", f"{base}/medians", as_of=AS_OF)
    assert incremental_tables(spark, f"{base}/out")["vw_category_performance"].first()["total_revenue"] == 7.0
    with pytest.raises(ValueError, match="median table"):
        apply_batch(orders_df(spark, [order("B")]), 1, f"{base}/out", as_of=AS_OF)


def test_future_orders_become_due(spark):
    out = scratch_path(spark, "due")
    rows = [order("A", "2001-06-16 10:00:00"), order("B", "2001-07-01 00:00:00", revenue=None), order("C")]
    apply_batch(orders_df(spark, rows), 0, out, as_of="2001-06-15 12:00:00")
    _check(spark, out, orders_df(spark, rows), "2001-06-15 12:00:00")
    more = [order("D", "2001-06-16 18:00:00"), order("A", "2001-06-16 09:00:00")]
    apply_batch(orders_df(spark, more), 1, out, as_of="2001-06-16 12:00:00")
    _check(spark, out, orders_df(spark, rows + more), "2001-06-16 12:00:00")


# --- the parts of the state --------------------------------------------------------


def test_histogram_medians_equal_the_batch_job(spark, monkeypatch):
    r = random.Random(3)
    amounts = ["0.00", "-0.01", "0.01", "999999999999.99", "-5.00", None] + [f"{r.randint(0, 10**6)}.{r.randint(10, 99)}" for _ in range(300)]
    rows = [order(f"O{k}", category=r.choice(["A", "B", None]), revenue=r.choice(amounts)) for k in range(900)]
    rows += [order("E", category="empty", revenue=None), order("one", category="one", revenue="-7.77")]
    out = scratch_path(spark, "histogram")
    runs, coarse = [], []
    for k in range(3):
        path = f"{out}/{k}"
        value_histogram.write_fine(value_histogram.batch_histogram(orders_df(spark, rows[k::3])), path)
        runs.append([0, path])
        coarse.append(value_histogram.read_fine(spark, [[0, path]]))
    want = _rows(cleaning.category_median(orders_df(spark, rows)))
    got = value_histogram.medians(value_histogram.coarse_counts(coarse), value_histogram.read_fine(spark, runs))
    assert _rows(got) == want
    assert "PushedFilters: [In(bucket" in got._jdf.queryExecution().executedPlan().toString() or "In(bucket" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(value_histogram, "PUSHED", 1)  # too many target buckets for a list
    assert _rows(value_histogram.medians(value_histogram.coarse_counts(coarse), value_histogram.read_fine(spark, runs))) == want


def test_buckets_rise_with_the_value(spark):
    r = random.Random(1)
    cents = sorted({r.randint(-(10**k), 10**k) for k in range(1, 17) for _ in range(40)} | set(range(-300, 300)))
    df = spark.createDataFrame([(c,) for c in cents], "c long").select("c", value_histogram.bucket_of((F.col("c") / 100).cast("decimal(18,2)")).alias("b"))
    got = [r["b"] for r in df.orderBy("c").collect()]
    assert got == sorted(got) and len(set(got)) > 500


def _store(spark, monkeypatch, rows_a_bucket=50):
    monkeypatch.setattr(keyed_store, "BUCKET_ROWS", rows_a_bucket)
    schema = spark.createDataFrame([], "k string, v int").schema
    return KeyedStore(spark, scratch_path(spark, "keyed"), "t", ["k"], schema, merge_runs=3)


def test_look_ups_read_the_buckets_of_their_keys_only(spark, monkeypatch):
    store = _store(spark, monkeypatch)
    runs = [store.write(spark.range(1000).selectExpr(f"concat('{n}-', id) AS k", "CAST(id AS INT) AS v"), n) for n in range(4)]
    assert all(r["buckets"] == 32 for r in runs)
    keys = store.hashed(spark.createDataFrame([("1-7",), ("2-9",), ("absent",)], "k string"))
    found = store.candidates(runs, keys)
    files = found.select(F.input_file_name()).distinct().count()
    assert 2 <= files <= 3  # of 128 bucket files
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString()
    assert found.count() < 200  # of 4,000 rows
    assert _rows(store.look_up(runs, keys)) == [("1-7", 7), ("2-9", 9)]


def test_the_filters_keep_most_absent_keys_from_reading(spark, monkeypatch):
    store = _store(spark, monkeypatch, 100_000)
    runs = [store.write(spark.range(20_000).selectExpr("concat('x', id) AS k", "1 AS v"), 0)]
    bloom = store._bloom(runs[0])
    assert bloom.count() == runs[0]["blocks"] == 10
    misses = 0
    for n in range(10):
        keys = store.hashed(spark.createDataFrame([(f"y{n}",)], "k string"))
        misses += store.candidates(runs, keys) is None
    assert misses >= 8
    present = store.hashed(spark.range(20_000).selectExpr("concat('x', id) AS k"))
    assert store.look_up(runs, present).count() == 20_000


def test_newest_rows_win_and_merges_are_neutral(spark, monkeypatch):
    store = _store(spark, monkeypatch)
    runs, want = [], {}
    r = random.Random(6)
    for version in range(7):
        rows = {r.choice([None, *[f"k{i}" for i in range(40)]]): [r.randint(0, 9) for _ in range(r.randint(1, 2))] for _ in range(30)}
        want.update(rows)
        df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs], "k string, v int")
        runs = store.merged(runs + [store.write(df, version)], drop=F.col("v") == 0 if version == 6 else None)
        assert len(runs) <= 4
    everything = sorted(((k, v) for k, vs in want.items() for v in vs), key=repr)
    assert _rows(store.everything(runs)) == everything
    keys = store.hashed(spark.createDataFrame([(None,), ("k1",), ("k2",), ("none",)], "k string"))
    assert _rows(store.look_up(runs, keys)) == [x for x in everything if x[0] in (None, "k1", "k2")]


def test_a_batch_reads_history_in_proportion_to_its_ids(spark, monkeypatch):
    monkeypatch.setattr(keyed_store, "BUCKET_ROWS", 100)
    out = scratch_path(spark, "bounded_read")
    day = dt.datetime(2000, 1, 1)
    rows = [order(f"O{k}", (day + dt.timedelta(days=k % 50)).isoformat(sep=" "), customer=f"C{k}") for k in range(3000)]
    apply_batch(orders_df(spark, rows), 0, out, as_of=AS_OF)
    read = []
    whole = KeyedStore.candidates

    def counting(self, runs, keys):
        found = whole(self, runs, keys)
        read.append((self.name, found.count() if found is not None else 0))
        return found

    monkeypatch.setattr(KeyedStore, "candidates", counting)
    few = [order("O5", "1999-01-01 00:00:00", customer="C5"), order("new", customer="C-new")]
    apply_batch(orders_df(spark, few), 1, out, as_of=AS_OF)
    assert {name for name, _ in read} == {"ids", "customers"} and all(n <= 3 * 200 for _, n in read)  # of 3,000
    assert read_pointer(spark, f"{out}/current.json")["ids"][0]["buckets"] == 32
    _check(spark, out, orders_df(spark, rows + few))
