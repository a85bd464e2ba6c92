"""Versions and pointers, concurrent registrations, reuse by content, rejected uploads."""

import threading

import pytest

from tillroll.plans.export import NothingToExport, export_report
from tillroll.sources import catalog, versions
from tillroll.sources.cache import cached_table, release
from tillroll.streaming.uploads import start_upload_stream

HEADER = "order_id,customer_name,product,category,region,quantity,revenue,payment_method,order_status,order_date\n"


def test_publish_and_refresh_keep_old_readers(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None
    first = versions.published(spark, root, lambda p: spark.range(3).write.parquet(p))
    old = spark.read.parquet(first)
    assert versions.published(spark, root, lambda p: 1 / 0) == first
    second = versions.published(spark, root, lambda p: spark.range(5).write.parquet(p), refresh=True)
    assert second != first and versions.current(spark, root) == second
    assert old.count() == 3 and spark.read.parquet(second).count() == 5


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ZeroDivisionError):
        versions.publish(spark, root, lambda p: 1 / 0)
    assert versions.current(spark, root) is None


def test_small_files_are_never_overwritten(spark, tmp_path):
    versions.write_small(spark, str(tmp_path / "x"), "one")
    with pytest.raises(Exception):
        versions.write_small(spark, str(tmp_path / "x"), "two")
    assert versions.read_small(spark, str(tmp_path / "x")) == "one"


def test_concurrent_registrations_get_two_ids_and_one_is_active(spark, tmp_path):
    root, ids = str(tmp_path / "cat"), []
    threads = [threading.Thread(target=lambda i=i: ids.append(catalog.register(spark, root, {"name": f"d{i}", "path": f"/p/{i}"}))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    listing = catalog.list_datasets(spark, root).collect()
    assert len(set(ids)) == 8 == len(listing) and sum(r["is_active"] for r in listing) == 1
    catalog.activate(spark, root, ids[3])
    assert catalog.active_dataset_path(spark, root) == next(r["path"] for r in listing if r["dataset_id"] == ids[3])


def test_an_unreadable_entry_is_an_error_and_no_empty_catalog(spark, tmp_path):
    root = str(tmp_path / "cat")
    assert catalog.datasets(spark, root).collect() == [] and catalog.active_sales(spark, root) is None
    catalog.register(spark, root, {"name": "a", "path": "/p"})
    (tmp_path / "cat" / "datasets" / "broken.json").write_text("{")
    with pytest.raises(Exception):
        catalog.datasets(spark, root).collect()


def test_an_overwritten_table_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = cached_table(spark, path)
    assert first.count() == 3 and cached_table(spark, path) is first
    spark.range(5).write.mode("overwrite").parquet(path)
    second = cached_table(spark, path)
    assert second.count() == 5 and second is not first and not first.is_cached
    assert release(spark, path) and not release(spark, path)


def test_a_bad_upload_does_not_stop_the_stream(spark, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "cat")
    landing.mkdir()
    good = HEADER + "1,Ann,Pen,Office,North,1,10.5,Card,Delivered,2024-01-05\n2,Bob,Ink,Office,South,2,3.5,Cash,Cancelled,2024-02-05\n"
    (landing / "a-ragged.csv").write_text(HEADER + "1,2,3,4,5,6,7,8,9,10,11\n")
    (landing / "b-columns.csv").write_text("x,y\n1,2\n")
    (landing / "c-good.csv").write_text(good)
    query = start_upload_stream(spark, str(landing), root, str(tmp_path / "store"), str(tmp_path / "ckpt"), once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    assert [r["name"] for r in catalog.datasets(spark, root).collect()] == ["c-good.csv"]
    errors = {r["name"]: r["error"] for r in catalog.rejected(spark, root).collect()}
    assert errors["a-ragged.csv"].startswith("RaggedFile") and "Missing required columns" in errors["b-columns.csv"]
    assert catalog.active_sales(spark, root).count() == 2


def test_an_empty_table_is_not_exported(spark, sample, tmp_path):
    for fmt in ("csv", "excel", "pdf"):
        with pytest.raises(NothingToExport):
            export_report(sample.limit(0), None, fmt, str(tmp_path / fmt))
        assert not (tmp_path / fmt).exists()


def test_action_labels(spark):
    events = spark.createDataFrame([(1, 5, "2024-01-02", "dataset_upload", "q1.csv"), (2, None, "2024-01-01", "click", None)],
                                   "event_id int, user_id int, ts string, event_type string, props string")
    users = spark.createDataFrame([(5, "ana")], "c_custkey int, c_name string")
    assert [(r["action_label"], r["shown"]) for r in catalog.recent_activity(events, users).collect()] == [
        ("Dataset Upload", "ana: Dataset Upload q1.csv"), ("click", "system: click")]
