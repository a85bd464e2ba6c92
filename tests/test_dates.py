"""One layout per date column, and bounds that no zone moves."""

import datetime as dt
import os
import time

import pytest

from tillroll.functions.dates import LAYOUTS, as_date, parse_or_null, winner
from tillroll.operators import cleaning as C
from tillroll.operators.breakdowns import daily_revenue
from tillroll.operators.filters import SalesFilter, apply_filters


def frame(spark, values, name="order_date"):
    return spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], f"order_id int, {name} string, revenue double").repartition(2)


def days(df, name="order_date"):
    return [str(r[0]) if r[0] else None for r in df.orderBy("order_id").select(as_date(df, name)).collect()]


@pytest.mark.parametrize(("values", "want"), [
    # one value that only day-first reads decides the whole column
    (["03/04/2024", "15/01/2024", "01/02/2024"], ["2024-04-03", "2024-01-15", "2024-02-01"]),
    (["03/04/2024", "01/15/2024"], ["2024-03-04", "2024-01-15"]),
    (["03/04/2024", "05/06/2024"], ["2024-03-04", "2024-05-06"]),                      # a tie: month first
    (["13/01/2024", "14/01/2024", "01/13/2024"], ["2024-01-13", "2024-01-14", None]),  # the minority is null
    (["3-4-2024", "25-12-2023"], ["2024-04-03", "2023-12-25"]),
    (["2024-01-02", "2024-01-03T10:00:00", "01/02/2024", "soon", None], ["2024-01-02", "2024-01-03", None, None, None]),
    (["31/02/2024", "30/01/2024"], [None, "2024-01-30"]), (["12:30", None], [None, None]), ([None, None], [None, None]), (["20240131"], ["2024-01-31"])])
def test_one_layout_per_column(spark, values, want):
    df = frame(spark, values)
    assert days(df) == want
    cleaned = C.clean_data(df.withColumnRenamed("order_id", "Order ID")).orderBy("order_id")
    if any(v for v in values):
        assert [str(r[0].date()) if r[0] else None for r in cleaned.select("order_date").collect()] == want
    row = C.profile(df).first()
    assert row["invalid_date_count"] == sum(v is not None and w is None for v, w in zip(values, want))


def test_columns_vote_on_their_own(spark):
    df = spark.createDataFrame([(1, "03/04/2024", "25/12/2023"), (2, "01/15/2024", "01/02/2024")], "order_id int, order_date string, ship_date string")
    out = C.parse_date_columns(df).orderBy("order_id").collect()
    assert [str(r["order_date"].date()) for r in out] == ["2024-03-04", "2024-01-15"]
    assert [str(r["ship_date"].date()) for r in out] == ["2023-12-25", "2024-02-01"]


def test_breakdowns_use_the_column_layout(spark):
    got = {str(r["day"]): r["revenue"] for r in daily_revenue(frame(spark, ["03/04/2024", "03/04/2024", "28/04/2024"])).collect()}
    assert got == {"2024-04-03": 2.0, "2024-04-28": 1.0}


def test_winner_and_layouts():
    assert winner([0] * len(LAYOUTS)) == 0 and winner([1, 5, 5, 0]) == 1


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def driver_zone(request):
    before = os.environ.get("TZ")
    os.environ["TZ"] = request.param
    time.tzset()
    yield request.param
    os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
    time.tzset()


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles"])
def test_bounds_stay_in_every_zone(spark, driver_zone, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        values = [f"2024-01-0{i}" for i in range(1, 6)]
        text = frame(spark, values)
        stamps = text.withColumn("order_date", parse_or_null(text, "order_date"))
        zoned = text.withColumn("order_date", parse_or_null(text, "order_date").cast("timestamp"))
        for df in (text, stamps, zoned, text.withColumn("order_date", as_date(text, "order_date"))):
            for start, end in (("2024-01-02", "2024-01-04"), ("01/02/2024", "Jan 4, 2024"), ("2024-01-02 00:00:00", "4 Jan 2024")):
                got = sorted(r["order_id"] for r in apply_filters(df, SalesFilter(date_start=start, date_end=end)).collect())
                assert got == [1, 2, 3], (df.dtypes, start)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_late_time_on_the_end_day_is_outside(spark):
    df = frame(spark, ["2024-01-02 00:00:00", "2024-01-02 09:30:00"])
    assert [r["order_id"] for r in apply_filters(df, SalesFilter(date_end="2024-01-02")).collect()] == [0]


def test_a_bound_that_is_no_date_is_an_error(spark):
    with pytest.raises(ValueError):
        apply_filters(frame(spark, ["2024-01-01"]), SalesFilter(date_start="soon"))
    assert dt.date(2024, 1, 1)
