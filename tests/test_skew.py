"""A key holding a third of the rows: the star join splits it, results stay whole."""

import duckdb
import pytest

from tillroll.plans.oracle import SALES
from tillroll.sources.sales import sales_view


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """Six star-schema tables; order 0 holds a third of the line items and
    customer 0 places a third of the orders."""
    d = tmp_path_factory.mktemp("skewed")
    n_lines, n_orders = 30_000, 3_000
    spark.range(5).selectExpr("cast(id as int) r_regionkey", "concat('R', id) r_name") \
        .write.parquet(str(d / "region.parquet"))
    spark.range(25).selectExpr("cast(id as int) n_nationkey", "concat('N', id) n_name",
                               "cast(id % 5 as int) n_regionkey").write.parquet(str(d / "nation.parquet"))
    spark.range(300).selectExpr("id c_custkey", "concat('Customer#', id) c_name", "cast(id % 25 as int) c_nationkey",
                                "1.0d c_acctbal", "'X' c_mktsegment").write.parquet(str(d / "customer.parquet"))
    spark.range(200).selectExpr("id p_partkey", "concat('part ', id % 40) p_name", "'B' p_brand",
                                "element_at(array('A', 'B', 'C'), cast(id % 3 as int) + 1) p_type",
                                "1 p_size", "1.0d p_retailprice").write.parquet(str(d / "part.parquet"))
    spark.range(n_orders).selectExpr(
        "id o_orderkey", "if(id % 3 = 0, 0L, id % 300) o_custkey",
        "element_at(array('O', 'F', 'P'), cast(id % 3 as int) + 1) o_orderstatus", "1.0d o_totalprice",
        "cast(timestampadd(DAY, cast(id % 700 as int), timestamp_ntz'1996-01-01 00:00:00') as timestamp_ntz) o_orderdate",
        "element_at(array('1-URGENT', '2-HIGH'), cast(id % 2 as int) + 1) o_orderpriority",
    ).write.parquet(str(d / "orders.parquet"))
    spark.range(n_lines).selectExpr(
        f"if(id % 3 = 0, 0L, id % {n_orders}) l_orderkey", "id % 200 l_partkey", "1L l_suppkey",
        "cast(id % 7 as int) l_linenumber", "cast(1 + id % 5 as double) l_quantity",
        "round(100 + (id % 997) * 1.37, 2) l_extendedprice", "round((id % 10) / 100.0, 2) l_discount", "0.0d l_tax",
        "element_at(array('A', 'N', 'R'), cast(id % 3 as int) + 1) l_returnflag",
        "element_at(array('O', 'F'), cast(id % 2 as int) + 1) l_linestatus",
        "cast(timestamp_ntz'1996-01-01 00:00:00' as timestamp_ntz) l_shipdate",
    ).write.parquet(str(d / "lineitem.parquet"))
    return str(d)


def test_hot_order_is_split_and_rows_are_whole(spark, skewed_dir):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = sales_view(spark, skewed_dir).select("order_id", "line_number", "customer_name", "product",
                                                  "region", "revenue", "order_status")
        rows = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan  # AQE split the hot key's partition
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(
        "WITH " + SALES.replace("SELECT l.l_orderkey AS order_id,",
                                "SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number,") +
        " SELECT order_id, line_number, customer_name, product, region, revenue, order_status FROM sales").fetchall())
    assert len(rows) == 30_000 and rows == want
