"""What lies on disk while a catalog is built: shuffle files, staged tables, cached tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillroll.operators import cleaning as C
from tillroll.plans import ingest as I
from tillroll.session import ensure_checkpoint_dir, path_bytes
from tillroll.sources import catalog, sales
from tillroll.sources.cache import cached_table, release
from tillroll.sources.sinks import write_table

HEAD = ("`Order ID` bigint, `Customer Name` string, `Product Name` string, `Product Category` string, Region string, Quantity double, "
        "Sales string, `Payment Method` string, `Order Status` string, `Order Date` string, Notes string")


def raw_rows(n=4_000):
    some = [(i, f"c{i * 7919 % n}", f"p{i * 31 % 900}", None if i % 17 == 0 else "A", "N", float(i % 9), "n/a?" if i % 23 == 0 else f"{i * 37 % 9973}.25",
             "Card", "Shipped", f"{i % 28 + 1:02d}/{i % 12 + 1:02d}/2023", None) for i in range(n)]
    return some + some[::29]


def shuffled(spark):
    """Names and bytes of the shuffle files that lie on disk."""
    files = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def left_by(spark, job):
    before = shuffled(spark)
    job()
    return sum(n for name, n in shuffled(spark).items() if name not in before)


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    df = spark.range(20_000).repartition(5, "id")
    assert left_by(spark, lambda: write_table(df, str(tmp_path / "t"))) == 0
    assert left_by(spark, lambda: df.write.parquet(str(tmp_path / "u"))) > 20_000
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000


@pytest.mark.parametrize("rounds", [1, 3])
def test_the_join_in_rounds_stores_every_row_once_and_leaves_no_shuffle_files(spark, monkeypatch, rounds):
    size = sum(path_bytes(spark, f"{SF_SMALL}/{t}.parquet") for t in sales.SOURCE_TABLES)
    monkeypatch.setattr(sales, "ROUND_BYTES", size // (rounds - 1) if rounds > 1 else 2 * size)
    monkeypatch.setattr(sales, "MOST_ROUNDS", 3)
    monkeypatch.setattr(sales, "STORE_VERSION", f"test-{rounds}")
    assert sales.join_rounds(spark, SF_SMALL) == rounds
    paths = []
    assert left_by(spark, lambda: paths.append(sales.materialize_sales(spark, SF_SMALL, refresh=True))) == 0
    stored = spark.read.schema(sales.STORED_SCHEMA).parquet(paths[0]).drop("order_month")
    assert Counter(stored.collect()) == Counter(sales.sales_view(spark, SF_SMALL).collect())


def test_rounds_have_an_end(spark, monkeypatch):
    monkeypatch.setattr(sales, "ROUND_BYTES", 1)
    assert sales.join_rounds(spark, SF_SMALL) == sales.MOST_ROUNDS


def test_rounds_take_repeated_and_null_keys_as_one_join_does(spark, tmp_path):
    def make(name, rows, schema, *more):
        spark.createDataFrame(rows, schema).select("*", *more).write.parquet(str(tmp_path / f"{name}.parquet"))

    make("region", [(0, "R")], "r_regionkey int, r_name string")
    make("nation", [(0, 0)], "n_nationkey int, n_regionkey int")
    make("customer", [(1, "a", 0), (1, "b", 0), (None, "c", 0)], "c_custkey bigint, c_name string, c_nationkey int")
    make("part", [(1, "p", "A"), (1, "q", None), (None, "r", "B")], "p_partkey bigint, p_name string, p_type string")
    make("orders", [(i, None if i == 3 else 1, s, "1") for i in (1, 2, 2, 3, 4, 5, None) for s in ("P", "O", None)],
         "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
         F.lit("1997-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    make("lineitem", [(i, 1 if i else None, n, 1.0, 10.0, 0.1, flag, line) for i in (1, 2, 4, 5, 9, None) for n in (1, 1, 2)
                      for flag, line in (("R", "O"), ("A", "O"), (None, "F"), ("N", None))],
         "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
         "l_returnflag string, l_linestatus string")
    whole = Counter(sales.sales_view(spark, str(tmp_path)).collect())
    parts = Counter()
    for i in range(4):
        parts += Counter(sales._with_status(sales._coded_sales(spark, str(tmp_path), i, 4)).collect())
    assert parts == whole and {r["order_status"] for r in whole} == set(sales.STATUSES)


def test_the_raw_table_is_gone_when_the_cleaned_one_is_written(spark, tmp_path, monkeypatch):
    staging, seen, write = f"{ensure_checkpoint_dir(spark)}/tillroll-staging", [], I.write_table
    before = set(os.listdir(staging)) if os.path.isdir(staging) else set()

    def watched(df, path, *more):
        seen.append((path, {x for x in os.listdir(staging) if x not in before and not x.startswith("repeated-")} if os.path.isdir(staging) else set()))
        return write(df, path, *more)

    monkeypatch.setattr(I, "write_table", watched)
    df, out = spark.createDataFrame(raw_rows(), HEAD), str(tmp_path / "out")
    got = I.ingest(spark, df, str(tmp_path / "cat"), out, "export")
    assert [path for path, _ in seen][1:] == [out]
    assert len(seen[1][1]) == 1 and next(iter(seen[1][1])).endswith("-parsed")
    assert got.row_count == len(set(raw_rows())) == catalog.active_sales(spark, str(tmp_path / "cat")).count()
    assert not any(x not in before and not x.startswith("repeated-") for x in os.listdir(staging))


def test_an_ingest_leaves_next_to_no_shuffle_files(spark, tmp_path):
    df = spark.createDataFrame(raw_rows(), HEAD).cache()
    df.count()
    assert left_by(spark, lambda: I.ingest(spark, df, str(tmp_path / "cat"), str(tmp_path / "out"), "export")) < 4 * len(raw_rows())
    df.unpersist()


def test_a_hash_that_is_shuffled_has_48_bits(spark):
    hashed = spark.range(2_000).toDF("__c0").select(*C._row_hashes(["__c0"]))
    assert hashed.agg(F.min("__h1") >= 0, F.max("__h1") < 1 << 48).first() == (True, True) and hashed.distinct().count() == 2_000


def test_a_stored_table_is_not_written_to_local_disk_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    held = cached_table(spark, path)
    assert held.storageLevel.useMemory and not held.storageLevel.useDisk and held.count() == 10
    release(spark, path)
    made = cached_table(spark, path, lambda s, p: s.read.parquet(p).where("id > 2"))
    assert made.storageLevel.useDisk and made.count() == 7
    release(spark, path)
