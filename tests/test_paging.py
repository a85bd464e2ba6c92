"""Pages by the day index against a plain sort."""

import datetime as dt
import random

import pytest

from conftest import SF_SMALL
from test_plans import executed
from tillroll.operators import paging as L
from tillroll.plans.registry import QUERIES
from tillroll.sources.sales import load_sales, sales_day_index

SCHEMA = "order_id bigint, product string, order_date date, revenue double"


def rows(n=700, seed=5, days=40, hot=0.4):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        day = None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=0 if rng.random() < hot else rng.randrange(days))
        out.append((None if rng.random() < 0.02 else rng.randrange(-50, 10**6), rng.choice(["p", "q", None]), day, rng.choice([1.0, 2.0, None])))
    return out + out[:20]


def in_order(rs):
    key = lambda v: (v is not None, v)
    return sorted(rs, key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in (r[2] and r[2].toordinal(), r[0], r[1], r[3])] and [
        key(r[2])[0], r[2].toordinal() if r[2] else 0, r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[3] is not None, r[3] or 0])


@pytest.mark.parametrize("level", [1 << 20, 16])
def test_every_page_equals_the_sorted_slice(spark, monkeypatch, level):
    monkeypatch.setattr(L, "LEVEL_ROWS", level)
    monkeypatch.setattr(L, "RANGES", 8)
    rs = rows()
    df, want = spark.createDataFrame(rs, SCHEMA).repartition(4), in_order(rs)
    index = L.day_index(df).cache()
    for offset in (0, 5, 33, 34, 35, 120, 250, 300, len(rs) - 4, len(rs) - 1, len(rs), 2**40):
        got = [tuple(r) for r in L.rows_at(df, offset, 10, index).collect()]
        assert got == want[offset:offset + 10], offset
    assert [tuple(r) for r in L.page(df, 0).collect()] == want[(len(rs) - 1) // 10 * 10:]
    assert [tuple(r) for r in L.page(df, "x").collect()] == want[:10]


def test_days_are_all_that_is_read(spark):
    for name in ("orders_page", "orders_last_page", "preview_rows"):
        plan = executed(QUERIES[name](spark, SF_SMALL))
        read = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "order_month" in read, name


def test_text_ids_undated_and_empty_tables(spark):
    text = spark.createDataFrame([("b", None), ("a", None), (None, None)], "order_id string, order_date date")
    assert [r[0] for r in L.page(text, 1, 2).collect()] == [None, "a"]
    bare = spark.createDataFrame([(3,), (1,), (2,)], "order_id bigint")
    assert [r[0] for r in L.page(bare, 2, 2).collect()] == [3]
    assert L.page(bare.limit(0), 1).collect() == [] and L.preview(text.limit(0)).collect() == []


def test_stored_index_counts_every_row(spark):
    index = sales_day_index(spark, SF_SMALL)
    assert index.agg({"n": "sum"}).first()[0] == load_sales(spark, SF_SMALL).count()


def test_one_hot_order_holds_the_page(spark, monkeypatch):
    monkeypatch.setattr(L, "LEVEL_ROWS", 4)
    rs = [(7, f"p{i:04d}", dt.date(2024, 1, 1), 1.0) for i in range(200)] + [(9, "z", dt.date(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rs, SCHEMA)
    assert [r["product"] for r in L.rows_at(df, 150, 3).collect()] == ["p0150", "p0151", "p0152"]
    assert [r["product"] for r in L.rows_at(df, 199, 3).collect()] == ["p0199", "z"]
