import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from tillroll.session import apply_engine_conf, ensure_checkpoint_dir

    builder = (SparkSession.builder.master("local[*]").appName("tillroll-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC"))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(session)
    if not session.conf.get("spark.checkpoint.dir", None) and not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture(scope="session")
def sample(spark):
    """The four-row sales frame of the reference's analytics tests."""
    rows = [
        (1, "Alice", "Laptop", "Electronics", "North", 1, 1000.0, "Credit Card", "Delivered", "2023-01-01"),
        (2, "Bob", "Mouse", "Accessories", "South", 2, 50.0, "PayPal", "Cancelled", "2023-01-05"),
        (3, "Alice", "Keyboard", "Accessories", "North", 1, 100.0, "Credit Card", "Delivered", "2023-02-01"),
        (4, "Charlie", "Laptop", "Electronics", "East", 1, 1000.0, "Cash", "Returned", "2023-03-01"),
    ]
    schema = ("order_id bigint, customer_name string, product string, category string, region string, "
              "quantity bigint, revenue double, payment_method string, order_status string, order_date string")
    return spark.createDataFrame(rows, schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()
