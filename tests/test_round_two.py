"""Cases that the driver tables do not hold: wide ranges, long ids, other date layouts, quotes, nulls."""

import random
import statistics

import pytest
from conftest import one

from tillroll.operators import breakdowns as B
from tillroll.operators import cleaning as C
from tillroll.operators import median as M
from tillroll.operators.forecast import forecast
from tillroll.session import file_fingerprint
from tillroll.sources.csv import read_sales_csv
from tillroll.sources.sinks import as_json, write_csv


def test_median_of_values_over_the_whole_double_range(spark, monkeypatch):
    monkeypatch.setattr(M, "SORTED", 300)
    rng = random.Random(2)
    rows = [(10 ** rng.uniform(-300, 300), float(rng.choice([1, 1, 1, 2, 7])), rng.gauss(0, 1)) for _ in range(8001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = M.exact_medians(df, ["a", "b", "c"])
    assert got == {c: statistics.median(r[i] for r in rows) for i, c in enumerate("abc")}


def test_nineteen_digit_ids_stay_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,long_id,gap\n1234567890123456781,12345678901234567890123,1\n1234567890123456782,12345678901234567890124,\n")
    df = read_sales_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"order_id": "bigint", "long_id": "string", "gap": "double"}
    assert df.select("order_id").distinct().count() == df.select("long_id").distinct().count() == 2


def test_other_header_order_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("product,region\nPen,North\n")
    (tmp_path / "b.csv").write_text("region,product\nSouth,Ink\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_sales_csv(spark, str(tmp_path)).collect()


def test_csv_round_trip_with_quotes(spark, tmp_path):
    rows = [('He said "hi", ok',), ('a\nb',), ("plain",), ('"',)]
    df = spark.createDataFrame(rows, "note string")
    path = write_csv(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in read_sales_csv(spark, path).collect()) == sorted(r[0] for r in rows)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '""hi""' in text and '\\"' not in text


def test_json_keeps_null_fields(spark):
    assert as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1,"b":null}'


@pytest.mark.parametrize(("text", "day"), [
    ("01/15/2024", "2024-01-15"), ("1-5-2024", "2024-01-05"), ("2024/01/15", "2024-01-15"), ("15.01.2024", "2024-01-15"),
    ("Jan 15, 2024", "2024-01-15"), ("2024-01-15 10:00", "2024-01-15"), ("12:30", None), ("soon", None), ("2024-02-31", None)])
def test_date_layouts(spark, text, day):
    from tillroll.functions.dates import as_date
    df = spark.createDataFrame([(text,)], "order_date string")
    got = df.select(as_date(df, "order_date").cast("string")).first()[0]
    assert got == day


def test_synonyms_of_mixed_types_merge_as_numbers(spark):
    df = C.apply_synonyms(spark.createDataFrame([(1.5, "9"), (None, "n/a?"), (None, "7")], "revenue double, sales string"))
    assert [r[0] for r in df.collect()] == [1.5, None, 7.0]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "revenue double")
    assert one(C.profile(df))["missing_values"]["revenue"] == 2


def test_region_category_has_no_cap_and_no_foreign_columns(spark):
    rows = [("N", f"c{i}", 1.0) for i in range(5)] + [(None, "only-here", 1.0), ("S", "c1", 2.0)]
    df = spark.createDataFrame(rows, "region string, category string, revenue double")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        got = {(r[0], r[1]): r[2] for r in B.region_category_long(df).collect()}
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    assert len(got) == 10 and got["S", "c0"] == 0 and got["S", "c1"] == 2 and not any(c == "only-here" for _, c in got)


def test_forecast_does_not_sort_raw_rows(spark, sample):
    plan = forecast(sample)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_fingerprint_sees_deeper_folders(spark, tmp_path):
    deep = tmp_path / "t" / "a=1" / "b=2"
    deep.mkdir(parents=True)
    (deep / "x").write_text("1")
    before = file_fingerprint(spark, str(tmp_path / "t"))
    (deep / "y").write_text("2")
    assert file_fingerprint(spark, str(tmp_path / "t")) != before
