"""Long value lists, plain-text search, and repeated rows by hash and comparison."""

import random

import pytest

from conftest import SF_SMALL, one
from test_plans import executed
from tillroll.operators import cleaning as C
from tillroll.operators import filters as X
from tillroll.operators.filters import SalesFilter, apply_filters
from tillroll.plans.registry import QUERIES
from tillroll.sources.sales import dirty_sales, load_sales


def test_a_long_list_equals_a_short_one_and_stays_out_of_the_plan(spark, monkeypatch):
    sales = load_sales(spark, SF_SMALL)
    short = SalesFilter(category=["ECONOMY", "PROMO"])
    long = SalesFilter(category=["PROMO", "ECONOMY", "ECONOMY", *(f"none {i}" for i in range(X.LONG_LIST))])
    want = apply_filters(sales, short)
    for bytes_ in (X.BROADCAST_BYTES, 0):  # broadcast, or both sides shuffled
        monkeypatch.setattr(X, "BROADCAST_BYTES", bytes_)
        got = apply_filters(sales, long)
        assert got.columns == sales.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = executed(QUERIES["filtered_orders_long_list"](spark, SF_SMALL))
    assert len(plan) < 20_000 and "EXTRA 77" not in plan and "LeftSemi" in plan
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "category" in pushed


def test_lists_of_every_column_and_null_values(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "b", None), (4, "c", "y")], "order_id int, region string, category string")
    many = [f"v{i}" for i in range(X.LONG_LIST)]
    assert [r[0] for r in apply_filters(df, SalesFilter(region=["a", "c", *many], category=["x", *many])).collect()] == [1]
    assert apply_filters(df, SalesFilter(region=many + ["zz"])).collect() == []


def test_search_as_pattern_and_as_text(spark):
    df = spark.createDataFrame([(1, "USB-C (2m)"), (2, "USB C 2m"), (3, None)], "order_id int, product string")
    ids = lambda **k: [r[0] for r in apply_filters(df, SalesFilter(**k)).collect()]
    assert ids(product_search="usb.c") == [1, 2] and ids(product_search="usb.c", product_literal=True) == []
    assert ids(product_search=" (2M) ", product_literal=True) == [1] and ids(product_search="(", product_literal=True) == [1]
    with pytest.raises(Exception):
        ids(product_search="(")


def repeated(n=300):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice(["a", "b", None]), rng.choice([0.5, None])) for _ in range(n)]
    return rows, "x int, y string, z string, w double"


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("keys", [1 << 20, 0])
def test_duplicates_even_when_all_hashes_clash(spark, monkeypatch, same, keys):
    monkeypatch.setattr(C, "BROADCAST_KEYS", keys)
    if same:
        monkeypatch.setattr(C, "_row_hashes", lambda columns: [C.F.lit(1).cast("bigint").alias(f"__h{i}") for i in (1, 2)])
    rows, schema = repeated()
    assert one(C.profile(spark.createDataFrame(rows, schema)))["duplicate_count"] == len(rows) - len(set(rows))


def test_no_repeats_and_no_rows(spark):
    assert one(C.profile(spark.range(50).selectExpr("id", "cast(null as string) as s")))["duplicate_count"] == 0
    assert one(C.profile(spark.createDataFrame([], "a int, b string")))["duplicate_count"] == 0


def test_hashes_tell_shifted_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").toDF("__c0", "__c1")
    assert df.select(*C._row_hashes(df.columns)).distinct().count() == 2


def test_only_hashes_of_all_rows_are_shuffled(spark):
    plan = executed(C.profile(dirty_sales(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
