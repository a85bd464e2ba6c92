"""The forecast per key against the single-series forecast of each key's rows."""

import random

import pytest

from conftest import SF_SMALL
from tillroll.operators.forecast import forecast
from tillroll.operators.forecast_by import forecast_by
from tillroll.sources.sales import load_sales
from test_plans import executed

SCHEMA = "product string, category string, region string, quantity bigint, revenue decimal(18,4), order_date date"


def rows(seed=11, n=900):
    import datetime as dt
    from decimal import Decimal
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        # a third of all rows in one region; products tie; months have gaps
        region = rng.choice(["hot", "hot", "hot", "N", "S", "E", "W", None, "thin"])
        day = None if rng.random() < 0.05 else dt.date(2023, rng.choice([1, 2, 3, 5, 8, 12]), rng.randrange(1, 28))
        if region == "thin" and day is not None:
            day = day.replace(month=rng.choice([1, 2]))  # two months only: no forecast
        out.append((rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), region, rng.choice([1, 1, 2, None]),
                    rng.choice([None, Decimal(rng.randrange(1, 99999)) / 100]), day))
    return out


@pytest.mark.parametrize("key", ["region", "product", "category"])
def test_every_key_equals_its_own_forecast(spark, key):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = {}
    for r in forecast_by(df, key).collect():
        got.setdefault(r[key], []).append(tuple(r)[1:])
    for value in [r[0] for r in df.select(key).distinct().collect()]:
        want = [tuple(r) for r in forecast(df.where(df[key] == value)).collect()] if value is not None else []
        assert sorted(got.get(value, [])) == want, value


def test_missing_columns_take_the_defaults(spark):
    df = spark.createDataFrame([(f"2024-0{m}-01", "k", 10.0 * m) for m in (1, 2, 3)], "order_date string, region string, revenue double")
    got = [tuple(r) for r in forecast_by(df, "region", 2).orderBy("period").collect()]
    assert got == [("k", "2024-04", 40.0, "N/A", 0, "N/A", 0.0), ("k", "2024-05", 50.0, "N/A", 0, "N/A", 0.0)]
    assert forecast_by(df, "nowhere").collect() == [] and forecast_by(df.drop("revenue"), "region").collect() == []


def test_one_scan_and_no_join(spark):
    plan = executed(forecast_by(load_sales(spark, SF_SMALL), "region")).split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
