"""CSV source on a written sample against plain Python, ingest gate, catalog, stream."""

import csv
import random
import shutil
from collections import Counter

import numpy as np
import pytest
from conftest import one

from tillroll.operators import breakdowns as B
from tillroll.operators import cleaning as C
from tillroll.operators.forecast import forecast, trend_fit
from tillroll.operators.kpis import kpi_card
from tillroll.operators.paging import page, page_number
from tillroll.plans.ingest import IngestRejected, ingest
from tillroll.sources import catalog
from tillroll.sources.csv import read_sales_csv
from tillroll.streaming.uploads import start_upload_stream

PRODUCTS = (("Lamp, small", "Home"), ("Kettle", "Kitchen"), ('15" Screen', "Electronics"), ("Earbuds", "Electronics"), ("Novel", "Books"))


def sample_rows(n=200, seed=21):
    """Orders of one year as an upload would carry them; every month occurs."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        product, category = rng.choice(PRODUCTS)
        rows.append({"Order ID": 1000 + i, "Order Date": f"2024-{i % 12 + 1:02d}-{rng.randrange(1, 29):02d}", "Customer Name": f"Customer {rng.randrange(120)}",
                     "Product": product, "Category": category, "Region": rng.choice(["North", "South", "East", "West"]), "Quantity": rng.randrange(1, 4),
                     "Unit Price": 10 * rng.randrange(1, 50), "Payment Method": rng.choice(["Card", "Cash", "UPI"]),
                     "Order Status": rng.choice(["Delivered"] * 6 + ["Shipped", "Cancelled", "Returned"])})
        rows[-1]["Revenue"] = rows[-1]["Quantity"] * rows[-1]["Unit Price"]
    return rows


@pytest.fixture(scope="module")
def sample_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "sales.csv"
    rows = sample_rows()
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def cleaned(spark, sample_csv):
    return C.clean_data(read_sales_csv(spark, sample_csv))


def sums(key, value="Revenue"):
    out = Counter()
    for r in sample_rows():
        out[r[key] if key != "month" else r["Order Date"][:7]] += r[value] if value else 1
    return out


def leader(found, sign=-1):
    return min(found, key=lambda k: (sign * found[k], k))


def test_sample_kpis(cleaned):
    rows, k = sample_rows(), one(kpi_card(cleaned))
    total, status, months = sum(r["Revenue"] for r in rows), sums("Order Status", None), sums("month")
    assert k["total_revenue"] == total and k["total_orders"] == 200 and k["aov"] == total / 200
    assert (k["top_region"], k["top_category"]) == (leader(sums("Region")), leader(sums("Category")))
    assert (k["cancellation_rate"], k["return_rate"]) == (status["Cancelled"] / 200 * 100, status["Returned"] / 200 * 100)
    people = sums("Customer Name", None)
    assert k["returning_customer_rate"] == pytest.approx(100 * sum(n > 1 for n in people.values()) / len(people))
    assert k["avg_basket_size"] == sum(r["Quantity"] for r in rows) / 200
    assert (k["best_sales_month"], k["worst_sales_month"]) == (leader(months), leader(months, 1))
    last, before = months["2024-12"], months["2024-11"]
    assert k["monthly_growth"] == pytest.approx(100 * (last - before) / before)


def test_sample_breakdowns(cleaned):
    products, months = sums("Product"), sums("month")
    assert [(r["product"], r["revenue"]) for r in B.top_products(cleaned).collect()] == sorted(products.items(), key=lambda x: (-x[1], x[0]))
    assert [r["revenue"] for r in B.monthly_revenue(cleaned).collect()] == [months[m] for m in sorted(months)]
    assert {r["order_status"]: r["count"] for r in B.order_status_counts(cleaned).collect()} == sums("Order Status", None)
    cancelled = Counter(r["Region"] for r in sample_rows() if r["Order Status"] == "Cancelled")
    rates = {r["region"]: r["cancel_rate"] for r in B.region_cancellation(cleaned).collect()}
    assert rates == {k: pytest.approx(100 * n / sums("Region", None)[k]) for k, n in cancelled.items()}
    wide = B.region_category_matrix(cleaned).collect()
    assert [r["region"] for r in wide] == ["East", "North", "South", "West"] and set(wide[0].asDict()) == {"region", *sums("Category")}
    assert sum(sum(v for c, v in r.asDict().items() if c != "region") for r in wide) == sum(products.values())


def test_sample_forecast(cleaned):
    months = sums("month")
    x, y = np.arange(12.0), np.array([float(months[m]) for m in sorted(months)])
    slope, intercept = np.polyfit(x, y, 1)
    fit = one(trend_fit(cleaned))
    assert fit["slope"] == pytest.approx(slope) and fit["intercept"] == pytest.approx(intercept)
    rows = forecast(cleaned).collect()
    assert [r["period"] for r in rows] == ["2025-01", "2025-02", "2025-03"]
    assert [r["predicted_revenue"] for r in rows] == [pytest.approx(max(0, intercept + slope * i), abs=0.01) for i in (12, 13, 14)]
    assert rows[0]["top_product"] == leader(sums("Product", "Quantity"))


def test_ingest_catalog_and_stream(spark, sample_csv, tmp_path):
    root = str(tmp_path / "catalog")
    r = ingest(spark, sample_csv, root, str(tmp_path / "store" / "first"), "first", owner="ana")
    assert (r.row_count, r.quality_score, r.quality_grade) == (200, 100, "Excellent")
    assert catalog.active_dataset_path(spark, root) == r.path
    landing = tmp_path / "landing"
    landing.mkdir()
    shutil.copy(sample_csv, landing / "second.csv")
    (landing / "notes.txt").write_text("ignored")
    q = start_upload_stream(spark, str(landing), root, str(tmp_path / "store"), str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(180)
    listing = catalog.list_datasets(spark, root).collect()
    assert [x["name"] for x in listing] == ["second.csv", "first"]
    assert [x["is_active"] for x in listing] == [True, False]
    assert [x["name"] for x in catalog.list_datasets(spark, root, search="FIR").collect()] == ["first"]
    assert [x["name"] for x in catalog.list_datasets(spark, root, status="inactive").collect()] == ["first"]
    assert [x["name"] for x in catalog.list_datasets(spark, root, sort="name").collect()] == ["first", "second.csv"]
    assert [x["name"] for x in catalog.list_datasets(spark, root, sort="bogus").collect()] == ["second.csv", "first"]


def test_ingest_rejects_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0)], "`Order ID` int, Sales double")
    with pytest.raises(IngestRejected) as e:
        ingest(spark, df, str(tmp_path / "cat"), str(tmp_path / "out"), "bad")
    assert e.value.missing[0] == "customer_name"
    assert catalog.active_dataset_path(spark, str(tmp_path / "cat")) is None


def test_page_number_rule():
    assert page_number("x", 95) == 1
    assert page_number(0, 95) == 10 and page_number(11, 95) == 10 and page_number(3, 95) == 3
    assert page_number(1, 0) == 1


def test_page_rows(sample):
    assert [r["order_id"] for r in page(sample, 1, size=3).collect()] == [1, 2, 3]
    assert [r["order_id"] for r in page(sample, 99, size=3).collect()] == [4]
