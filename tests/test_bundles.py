"""Endpoint bundles, export endpoint, cache and dataset preview."""

import pytest
from conftest import SF_SMALL, one

from tillroll.operators import breakdowns as B
from tillroll.operators.filters import SalesFilter
from tillroll.operators.kpis import kpi_card
from tillroll.plans import bundles as E
from tillroll.plans.export import export_report
from tillroll.sources import catalog
from tillroll.sources.cache import cached_table, release
from tillroll.sources.sales import load_sales

SPEC = SalesFilter(date_start="1996-01-01", date_end="1999-12-31", region=["ASIA", "EUROPE"])


@pytest.fixture(scope="module")
def sales(spark):
    return load_sales(spark, SF_SMALL)


def test_dashboard_bundle_agrees_with_single_operators(sales):
    from tillroll.operators.filters import apply_filters
    d = E.dashboard(sales, SPEC, page_number=2)
    f = apply_filters(sales, SPEC)
    assert one(d["kpis"]) == one(kpi_card(f))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(d["monthly_trend"]) == rows(B.monthly_revenue(f))
    assert rows(d["category_rev"]) == rows(B.revenue_by_category(f))
    assert rows(d["payment_methods"]) == rows(B.payment_method_counts(f))
    assert rows(d["order_status"]) == rows(B.order_status_counts(f))
    assert rows(d["heatmap"]) == rows(B.region_category_long(f))
    assert [str(r["day"]) for r in d["daily_trend"].collect()] == [str(r["day"]) for r in B.daily_revenue(f).collect()]
    assert d["page"].count() == 10
    assert d["insights"].count() > 0 and d["forecast"].count() == 3
    assert one(d["forecast_meta"])["confidence"] == "Moderate"
    assert d["filter_options"].count() == B.filter_options(sales).count()
    cached = list(d[E.CACHED])
    assert all(df.is_cached for df in cached)
    E.release(d)
    assert E.CACHED not in d and not any(df.is_cached for df in cached)


def test_rollup_totals_are_consistent(sales):
    r = E.dashboard_rollup(sales)
    total = one(r.where("breakdown = 'total'"))
    for level in ("month", "category", "region", "payment_method", "order_status", "region_category", "day"):
        part = r.where(f"breakdown = '{level}'").groupBy().sum("revenue", "row_count").first()
        assert part[0] == pytest.approx(total["revenue"]) and part[1] == total["row_count"]


def test_report_endpoint(sales):
    rep = E.report_endpoint(sales, SalesFilter(date_start="1997-01-01", date_end="1998-12-31"))
    assert one(rep["kpis"])["total_revenue"] > 0
    assert rep["insights"].where("category = 'Revenue Insights'").count() >= 2


@pytest.mark.parametrize("fmt", ["csv", "excel", "pdf"])
def test_export_report(spark, sales, tmp_path, fmt):
    paths = export_report(sales, SPEC, fmt, str(tmp_path / fmt))
    for p in paths.values():
        assert spark.read.format("json" if fmt == "pdf" else "csv").option("header", True).load(p).count() > 0


def test_export_rejects_unknown_format(sales, tmp_path):
    with pytest.raises(ValueError):
        export_report(sales, None, "docx", str(tmp_path / "x"))


def test_cache_reuses_and_releases(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    a = cached_table(spark, path)
    assert cached_table(spark, path) is a and a.is_cached
    assert release(spark, path) and not release(spark, path)


def test_dataset_preview(spark, sales, tmp_path):
    from tillroll.plans.ingest import ingest
    from tillroll.sources.sales import canonical
    raw = canonical(sales).limit(200)
    res = ingest(spark, raw, str(tmp_path / "cat"), str(tmp_path / "store"), "slice")
    view = catalog.dataset_preview(spark, str(tmp_path / "cat"), res.dataset_id)
    assert view["rows"].count() == 15 and "revenue" in view["columns"]
    prof = one(view["profile"])
    assert prof["total_rows"] == 200 and prof["data_type_warnings"] == []


def test_json_rows(sample):
    import json

    from tillroll.sources.sinks import as_json
    rows = [json.loads(r["json"]) for r in as_json(kpi_card(sample)).collect()]
    assert rows[0]["total_revenue"] == 2150.0 and rows[0]["top_region"] == "North"


def test_system_counts_and_newest_first(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey bigint, c_name string")
    events = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 9)], "event_id bigint, user_id bigint")
    root = str(tmp_path / "cat")
    catalog.register(spark, root, {"name": "x", "path": "/p/x"})
    catalog.register(spark, root, {"name": "y", "path": "/p/y"})
    got = one(catalog.system_counts(users, events, catalog.with_active_flag(spark, root)))
    assert got == {"total_users": 3, "active_users": 2, "total_datasets": 2, "active_datasets": 1}
    listing = catalog.newest_first(catalog.datasets(spark, root), "uploaded_at", "dataset_id").collect()
    assert [r["name"] for r in listing] == ["y", "x"]
