"""Filters on the stored sales table: semantics, idempotence and pushdown."""

import pytest
from conftest import SF_SMALL

from tillroll.operators.filters import SalesFilter, apply_filters, date_presets
from tillroll.sources.sales import load_sales

SPEC = SalesFilter(date_start="1996-01-01", date_end="1998-12-31", category=["PROMO", "SMALL"],
                   region="ASIA", payment_method=["1-URGENT"], order_status=["Delivered", "Shipped"],
                   revenue_min="1000.005", revenue_max=50000, product_search="red|blue")


@pytest.fixture(scope="module")
def sales(spark):
    return load_sales(spark, SF_SMALL)


def test_every_row_satisfies_the_spec(sales):
    rows = apply_filters(sales, SPEC).collect()
    assert rows
    for r in rows:
        assert "1996-01-01" <= r["order_date"].isoformat() <= "1998-12-31"
        assert r["category"] in ("PROMO", "SMALL") and r["region"] == "ASIA"
        assert r["payment_method"] == "1-URGENT" and r["order_status"] in ("Delivered", "Shipped")
        assert 1000.005 <= float(r["revenue"]) <= 50000
        assert "red" in r["product"] or "blue" in r["product"]


def test_filter_idempotent(sales):
    once = apply_filters(sales, SPEC)
    assert sorted(map(tuple, apply_filters(once, SPEC).collect())) == sorted(map(tuple, once.collect()))


def test_empty_spec_is_identity(sales):
    spec = SalesFilter(category=[], region="", revenue_min="", product_search="   ")
    assert apply_filters(sales, spec).count() == sales.count()


def test_filters_reach_the_scan(sales):
    plan = apply_filters(sales, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "order_date" in plan
    assert "PartitionFilters" in plan and "order_month" in plan
    assert "revenue" in plan.split("PushedFilters")[1]


def test_date_presets(spark):
    df = spark.createDataFrame([("2024-05-31",), ("2024-01-02",)], "order_date string")
    got = [tuple(r) for r in date_presets(df).collect()]
    assert got == [("Last 7 days", "2024-05-25", "2024-05-31"), ("This month", "2024-05-01", "2024-05-31"),
                   ("Last quarter", "2024-01-01", "2024-03-31"), ("This year", "2024-01-01", "2024-05-31")]


def test_long_value_list_takes_the_same_path(sales):
    regions = ["ASIA", "EUROPE"] + [f"nowhere-{i}" for i in range(2005)]
    got = apply_filters(sales, SalesFilter(region=regions))
    assert got.columns == apply_filters(sales, SalesFilter(region=["ASIA"])).columns == sales.columns
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == sales.where("region in ('ASIA', 'EUROPE')").count()
