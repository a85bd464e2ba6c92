"""The sales fact table over the driver's star schema (J5), stored once.

The reference works on one denormalised sales file.  Over the driver tables
that file is a five-way join.  Re-joining ~100 TB of lineitem per dashboard
request would shuffle the whole fact table each time, so the join runs once
as an ingest job and is written as parquet partitioned by order month (the
reference's "store the cleaned dataset" step).  Later queries read only the
columns they use, push filters into the scan and prune months.

Join plan: nation and region are fixed-size dimensions (25 and 5 rows by
definition) and are broadcast explicitly.  customer, orders and part grow
with the data, so no hint is given: AQE broadcasts them only when the
runtime size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
keeps the sort-merge join, splitting skewed keys (skewJoin.enabled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from ..functions.dates import month_label
from ..operators.paging import day_index
from ..session import derived_table_path, file_fingerprint, path_bytes
from . import rollups, sketches
from .sinks import write_table
from .tables import read_table, table_path
from .versions import published

SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")
STORE_VERSION = "sales-v2"

CANONICAL = (
    "order_id", "customer_name", "product", "category", "region", "quantity",
    "revenue", "payment_method", "order_status", "order_date",
)

STORED_SCHEMA = StructType([
    StructField("order_id", LongType()),
    StructField("line_number", IntegerType()),
    StructField("customer_name", StringType()),
    StructField("product", StringType()),
    StructField("category", StringType()),
    StructField("region", StringType()),
    StructField("quantity", DoubleType()),
    StructField("revenue", DecimalType(18, 4)),
    StructField("payment_method", StringType()),
    StructField("order_status", StringType()),
    StructField("order_date", DateType()),
    StructField("order_month", StringType()),
])


# Rows are shuffled with a status's place in this list, not with its text.
STATUSES = ("Returned", "Cancelled", "Pending", "Shipped", "Delivered")


def _status_code(returned: Column, o_orderstatus: Column, open_line: Column) -> Column:
    place = {name: i for i, name in enumerate(STATUSES, 1)}
    return (F.when(returned, place["Returned"])
            .when((o_orderstatus == "P") & open_line, place["Cancelled"])
            .when(o_orderstatus == "P", place["Pending"])
            .when(o_orderstatus == "O", place["Shipped"])
            .otherwise(place["Delivered"])).cast("tinyint")


def _with_status(coded: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STATUSES])
    return coded.withColumn("order_status", F.element_at(names, F.col("order_status").cast("int")))


def _in_round(key: str, round_: int, rounds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(rounds)) == round_


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy join of the driver tables into the canonical sales columns."""
    return _with_status(_coded_sales(spark, sf_dir))


def _coded_sales(spark: SparkSession, sf_dir: str, round_: int = 0, rounds: int = 1) -> DataFrame:
    """The join with its statuses as codes: of all orders, or of one in ``rounds`` by hash."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open_line"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    if rounds > 1:
        li, orders = li.where(_in_round("l_orderkey", round_, rounds)), orders.where(_in_round("o_orderkey", round_, rounds))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")

    # 25 x 5 rows by definition: a proven size bound, so broadcast.
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", "r_name")
    cust = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey) \
        .select("c_custkey", "c_name", "r_name")
    ords = orders.join(cust, orders.o_custkey == cust.c_custkey)
    # parts first: the rows leave the last join order by order, which the next shuffle compresses better
    joined = li.join(part, li.l_partkey == part.p_partkey).join(ords, li.l_orderkey == ords.o_orderkey)

    price = F.col("l_extendedprice").cast(DecimalType(15, 2))
    discount = F.col("l_discount").cast(DecimalType(15, 2))
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.col("c_name").alias("customer_name"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.col("l_quantity").cast("double").alias("quantity"),
        (price * (F.lit(1) - discount)).cast(DecimalType(18, 4)).alias("revenue"),
        F.col("o_orderpriority").alias("payment_method"),
        _status_code(F.col("returned"), F.col("o_orderstatus"), F.col("open_line")).alias("order_status"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def sales_store_path(spark: SparkSession, sf_dir: str) -> str:
    key = "|".join([STORE_VERSION] + [file_fingerprint(spark, table_path(sf_dir, t)) for t in SOURCE_TABLES])
    return derived_table_path(spark, "sales", key)


# Bytes of the source tables from which on the join takes one round more, and the most rounds.
ROUND_BYTES = 256 << 20
MOST_ROUNDS = 4


def join_rounds(spark: SparkSession, sf_dir: str) -> int:
    return min(MOST_ROUNDS, 1 + sum(path_bytes(spark, table_path(sf_dir, t)) for t in SOURCE_TABLES) // ROUND_BYTES)


def materialize_sales(spark: SparkSession, sf_dir: str, refresh: bool = False) -> str:
    """Write the joined table once per source fingerprint; return its path.

    ``rebalance`` lets AQE size the write tasks (split hot months, merge small
    ones) so output files stay near the advisory size at any scale.  Rows are
    sorted by date inside each file so date predicates skip row groups.  Each
    write is a version of its own, published when it is whole: a reader never
    sees a half-written table nor loses the one it reads, and a lost executor
    only retries its task.

    The three shuffles of the join are many times the stored table.  Large tables
    are joined in rounds, each order in one of them, and the shuffle files of a
    round go before the next: less disk for more scans of lineitem.
    """
    def write(path: str) -> None:
        rounds = join_rounds(spark, sf_dir)
        for i in range(rounds):
            df = _coded_sales(spark, sf_dir, i, rounds).withColumn("order_month", month_label(F.col("order_date")))
            dealt = _with_status(df.hint("rebalance", "order_month"))
            write_table(dealt.sortWithinPartitions("order_month", "order_date", "order_id", "line_number"),
                        path, "append" if i else "errorifexists", ["order_month"])

    return published(spark, sales_store_path(spark, sf_dir), write, refresh)


def sales_day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day of the stored table, written once beside it: a row per calendar day."""
    stored = materialize_sales(spark, sf_dir)
    root = derived_table_path(spark, "sales-days", stored)
    path = published(spark, root, lambda p: day_index(load_sales(spark, sf_dir)).coalesce(1).write.parquet(p))
    return spark.read.schema("day date, n bigint").parquet(path)


def sales_rollups(spark: SparkSession, sf_dir: str) -> str:
    """Partial sums per month of the stored table, made once per version of it; returns their folder."""
    stored = materialize_sales(spark, sf_dir)
    root = derived_table_path(spark, "sales-rollups", stored)
    rollups.add(spark, root, load_sales(spark, sf_dir), batch=stored.rsplit("/", 1)[-1])
    return root


def sales_sketches(spark: SparkSession, sf_dir: str) -> str:
    """Sketches per month of the stored table, made once per version of it; returns their folder."""
    stored = materialize_sales(spark, sf_dir)
    root = derived_table_path(spark, "sales-sketches", stored)
    sketches.add(spark, root, load_sales(spark, sf_dir), batch=stored.rsplit("/", 1)[-1])
    return root


# A published version never changes, so a session reuses its scan and file listing.
_SCANS: dict[tuple[str, str], DataFrame] = {}


def load_sales(spark: SparkSession, sf_dir: str, with_month: bool = True) -> DataFrame:
    """Canonical sales table (plus the ``order_month`` partition column).

    ``order_month`` lets date filters prune whole month folders; operators
    that emit rows project the canonical columns only.
    """
    path = materialize_sales(spark, sf_dir)
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCANS or _SCANS[key].sparkSession is not spark:
        _SCANS[key] = spark.read.schema(STORED_SCHEMA).parquet(path)
    cols = list(CANONICAL) + (["order_month"] if with_month else [])
    return _SCANS[key].select(*cols)


def canonical(df: DataFrame) -> DataFrame:
    """Drop storage helper columns."""
    return df.select(*[c for c in df.columns if c not in ("order_month", "line_number")])


# --- dirty variant for the profiling / cleaning operators ----------------

DIRTY_COLUMNS = (
    "Order ID", "Customer Name", "Product Name", "Product Category", "Region",
    "Quantity", "Sales", "Payment Method", "Order Status", "Order Date", "Notes",
)


def dirty_sales(spark: SparkSession, sf_dir: str, date_layout: str | None = None) -> DataFrame:
    """Raw-looking export of the sales table with deterministic defects by key.

    Headers as a spreadsheet would carry them; category null when
    ``order_id % 17 = 0``; sales text ``'n/a?'`` when ``% 23 = 0``; date
    ``'32-13-2023'`` when ``% 31 = 0``; negative sales when ``% 37 = 0``; an
    all-empty ``Notes`` column; every row with ``% 29 = 0`` appears twice.
    Every source row is kept.  ``date_layout`` writes the dates in another layout than ISO.
    """
    s = load_sales(spark, sf_dir, with_month=False)
    k = F.col("order_id")
    rev_text = F.col("revenue").cast("string")
    base = s.select(
        k.alias("Order ID"),
        F.col("customer_name").alias("Customer Name"),
        F.col("product").alias("Product Name"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("Product Category"),
        F.col("region").alias("Region"),
        F.col("quantity").alias("Quantity"),
        F.when(k % 23 == 0, F.lit("n/a?"))
         .when(k % 37 == 0, F.concat(F.lit("-"), rev_text))
         .otherwise(rev_text).alias("Sales"),
        F.col("payment_method").alias("Payment Method"),
        F.col("order_status").alias("Order Status"),
        F.when(k % 31 == 0, F.lit("32-13-2023"))
         .otherwise(F.date_format("order_date", date_layout) if date_layout else F.col("order_date").cast("string")).alias("Order Date"),
        F.lit(None).cast("string").alias("Notes"),
    )
    return base.unionByName(base.where(F.col("Order ID") % 29 == 0))


def dirty_sales_csv(spark: SparkSession, sf_dir: str) -> str:
    """The dirty variant exported once as CSV files (S6), for the CSV scan.

    Keyed by the stored table's version.  Returns the folder holding the ``*.csv`` parts.
    """
    from .sinks import write_csv

    root = derived_table_path(spark, "dirty-csv", f"dirty-csv-v1|{materialize_sales(spark, sf_dir)}")
    return published(spark, root, lambda p: write_csv(dirty_sales(spark, sf_dir), p))
