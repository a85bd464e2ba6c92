"""Partial sums and sketches per month: additive, idempotent, month by month; the dashboard from them."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from conftest import SF_SMALL
from test_plans import executed
from tillroll.operators.forecast import forecast
from tillroll.operators.insights import insights
from tillroll.operators.kpis import KPI_COLUMNS, kpi_card
from tillroll.plans.registry import QUERIES
from tillroll.plans.stored_dashboard import stored_dashboard
from tillroll.sources import rollups, sketches, versions
from tillroll.sources.sales import load_sales, sales_sketches

SCHEMA = ("order_id bigint, customer_name string, product string, category string, region string, quantity double, "
          "revenue decimal(18,4), payment_method string, order_status string, order_date date")


def batch(months, seed, n=150, first=0):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([*x, None]) if rng.random() < 0.2 else rng.choice(x)
    return [(first + rng.randrange(n // 2), pick("ann", "bob", "cy"), pick("pen", "ink"), pick("x", "y"), pick("N", "S"),
             pick(1.0, 2.0), None if rng.random() < 0.1 else Decimal(rng.randrange(100, 99999)) / 100, pick("card", "cash"),
             pick("Delivered", "Cancelled", "returned"),
             None if rng.random() < 0.05 else dt.date(2024, rng.choice(months), rng.randrange(1, 28))) for _ in range(n)]


def panel(df, name):
    return sorted((r["position"], r["key"], r["key2"], r["value"], r["text"]) for r in df.where(df["panel"] == name).collect())


def test_batches_add_up_and_touch_only_their_months(spark, tmp_path):
    root, one, two = str(tmp_path / "r"), batch([1, 2, 3, 4], 1), batch([3, 5], 2, first=40)
    a, b = spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA)
    rollups.add(spark, root, a, "a")
    before = {m: list(f) for m, f in rollups.parts(spark, root).items()}
    assert rollups.add(spark, root, b, "b") == ["2024-03", "2024-05", rollups.UNDATED]
    assert rollups.add(spark, root, b, "b") == []  # a replay
    after = rollups.parts(spark, root)
    assert all(after[m] == before[m] for m in ("2024-01", "2024-02", "2024-04")) and len(after["2024-03"]) == 2
    both = a.unionByName(b)
    got = stored_dashboard(spark, root)
    card = kpi_card(both).first()
    assert [(r[1], r[3] if r[3] is not None else r[4]) for r in panel(got, "kpis")] == [
        (c, float(card[c]) if isinstance(card[c], (int, float)) else card[c]) for c in KPI_COLUMNS]
    assert sorted((r[1], r[2], r[4]) for r in panel(got, "insights")) == sorted(
        (r["category"], r["severity"], r["text"]) for r in insights(both).collect())
    assert [(r[1], r[3]) for r in panel(got, "forecast_revenue")] == [(r["period"], r["predicted_revenue"]) for r in forecast(both).collect()]


def test_a_replaced_month_counts_once(spark, tmp_path):
    root = str(tmp_path / "r")
    rollups.add(spark, root, spark.createDataFrame(batch([1, 2], 3), SCHEMA).where("order_date is not null"), "a")
    new = [r for r in batch([2], 4, n=40) if r[9]]
    rollups.add(spark, root, spark.createDataFrame(new, SCHEMA), "b", replace=True)
    sums = rollups.read(spark, root, ["all"], "2024-02", "2024-02").first()
    assert sums["n"] == len(new) and sums["revenue"] == sum(r[6] for r in new if r[6] is not None)
    assert rollups.read(spark, root, ["all"]).count() == 2


def test_two_writers_of_one_batch_count_once(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path / "r"), spark.createDataFrame(batch([1, 2], 6), SCHEMA)
    rollups.add(spark, root, df, "a")
    want = sorted(map(tuple, rollups.read(spark, root, ["all", "product"]).collect()), key=str)
    # the second writer looked before the first one had published
    monkeypatch.setattr(rollups, "_markers", lambda *_: [])
    rollups.add(spark, root, df, "a")
    monkeypatch.undo()
    assert len(versions.names_in(spark, f"{root}/parts")) > len(rollups.parts(spark, root))
    assert sorted(map(tuple, rollups.read(spark, root, ["all", "product"]).collect()), key=str) == want


def test_an_empty_store_and_one_without_the_months(spark, tmp_path):
    root = str(tmp_path / "r")
    assert panel(stored_dashboard(spark, root), "kpis")[0][3] == 0.0
    rollups.add(spark, root, spark.createDataFrame(batch([1], 5), SCHEMA), "a")
    assert panel(stored_dashboard(spark, root, "2030-01", "2030-02"), "monthly_trend") == []
    assert panel(stored_dashboard(spark, root, "2030-01", "2030-02"), "filter_options") != []


def test_the_dashboard_reads_no_sales_row(spark):
    plan = executed(QUERIES["dashboard"](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    assert "sales-rollups" in plan and "customer_name" not in plan


def exact(df):
    revenue = sorted(float(r[0]) for r in df.select("revenue").collect())
    return df.select("order_id").distinct().count(), df.select("customer_name").distinct().count(), revenue


@pytest.mark.parametrize(("start", "end"), [(None, None), ("1996-01", "1999-06"), ("1995-05", "1995-05")])
def test_estimates_stay_in_their_bounds(spark, start, end):
    sales = load_sales(spark, SF_SMALL)
    kept = sales if start is None else sales.where(sales["order_month"].between(start, end))
    orders, customers, revenue = exact(kept)
    got = sketches.estimates(spark, sales_sketches(spark, SF_SMALL), start, end).first()
    assert got["row_count"] == len(revenue) and got["total_revenue"] == pytest.approx(sum(revenue))
    assert abs(got["total_orders"] - orders) <= max(1, sketches.DISTINCT_ERROR * orders)
    assert abs(got["customers"] - customers) <= max(1, sketches.DISTINCT_ERROR * customers)
    for value, q in ((got["median_revenue"], 0.5), (got["revenue_p95"], 0.95)):
        low, high = sum(x < value for x in revenue) / len(revenue), sum(x <= value for x in revenue) / len(revenue)
        assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR


def test_sketches_of_many_values_merge(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.range(300_000).selectExpr("id % 100000 as order_id", "concat('c', id % 777) as customer_name", "cast(id as decimal(18,4)) as revenue",
                                           "date_add(date'2024-01-01', cast(id % 300 as int)) as order_date")
    sketches.add(spark, root, rows.where("order_id % 2 = 0"), "even")
    sketches.add(spark, root, rows.where("order_id % 2 = 1"), "odd")
    got = sketches.estimates(spark, root).first()
    assert abs(got["total_orders"] - 100_000) <= sketches.DISTINCT_ERROR * 100_000 and abs(got["customers"] - 777) <= 22
    assert abs(got["median_revenue"] - 150_000) <= sketches.RANK_ERROR * 300_000
    assert sketches.estimates(spark, root, "2030-01", "2030-01").first()["total_orders"] == 0


def test_kpis_approx_reads_sketches_alone(spark):
    plan = executed(QUERIES["kpis_approx"](spark, SF_SMALL))
    assert "sales-sketches" in plan and plan.count("FileScan") == 1 and "PushedFilters: []" in plan
    assert versions.names_in(spark, "/nowhere/at/all") == []


def test_risk_rules_fire(spark):
    text = " ".join(r["text"] for r in QUERIES["insights_risks"](spark, SF_SMALL).collect())
    assert "of customers are returning" in text and "abnormal cancellation rate" in text
    assert [r["text"] for r in QUERIES["insights_no_data"](spark, SF_SMALL).collect()] == ["No data available to generate insights."]
