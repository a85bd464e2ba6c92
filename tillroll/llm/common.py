"""Helpers shared by the operators: tables, staged results, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir, remove_path

# Rows per Arrow batch handed to a Python worker: a batch of whole texts then
# stays at a few MB for usual documents.
ARROW_ROWS = 512
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def free_name(name: str, taken: list[str]) -> str:
    """``name`` behind as many underscores as it takes to clash with nothing (case aside)."""
    lowered = {c.lower() for c in taken}
    name = f"__{name}"
    while name in lowered:
        name = f"_{name}"
    return name


class Staging:
    """Intermediate tables in the folder that the whole cluster shares.

    A staged table cuts the lineage: a lost executor never re-runs what came
    before it.  ``drop`` removes tables that no later result reads.  The shuffle
    files of the write go when it has ended, as nothing reads them again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            remove_path(self.spark, df._staged_path)


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """Connected components of ``edges (a, b)``: one row ``(node, root)`` per node.

    Random-priority contraction: every node moves to the neighbour (or itself)
    of least priority, twice, then the edges are relabelled and loops dropped.
    Priorities are hashed anew each round, so the number of nodes with edges
    falls by a constant factor in expectation, for paths as for stars.  All
    steps are grouped minima and equi-joins; a hub's edges pre-aggregate.
    """
    left = staging.put(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels: DataFrame | None = None
    step = 0
    while left.limit(1).count():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), c.alias("v"))
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min(rank(F.col("b"))).alias("n"))
        hop = staging.put(near.select("v", F.least("n", rank(F.col("v")))["v"].alias("to")), "hop")
        nxt = hop.select(F.col("v").alias("to"), F.col("to").alias("to2"))
        move = staging.put(hop.join(nxt, "to").select("v", F.col("to2").alias("to")), "move")
        if labels is None:
            labels = move.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            new = move.select(F.col("v").alias("root"), "to")
            labels = labels.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = staging.put(labels, "labels")
        old, ends = left, move.select("v", "to")
        left = (left.join(ends.withColumnRenamed("v", "a").withColumnRenamed("to", "ra"), "a")
                .join(ends.withColumnRenamed("v", "b").withColumnRenamed("to", "rb"), "b")
                .where("ra <> rb")
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        left = staging.put(left, "edges")
        staging.drop(old, hop, move)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
