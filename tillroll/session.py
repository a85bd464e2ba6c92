"""Session construction and shared-storage helpers.

Every operator takes an existing ``SparkSession``; this module only builds
one for tests / benches and resolves the shared folder used for derived
tables (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings the engine relies on.  AQE re-plans joins (broadcast when
# the runtime size is under the threshold, sort-merge otherwise), coalesces
# small shuffle partitions and splits skewed ones.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # The stored sales table has one folder per calendar month (tens to a
    # few hundred, independent of data size): list them on the driver
    # instead of launching a listing job per query.
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1024",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; clusters pass their own."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g")
               # Call-site capture for error messages costs ~3 JVM round trips
               # per Column function while a plan is built; off for batch runs.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for key, value in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when a local session has none (tests) is a private one set; on a
    cluster a folder of one machine would lose rows, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), "tillroll-checkpoints")
    spark.sparkContext.setCheckpointDir(local)
    return local


def derived_table_path(spark: SparkSession, name: str, key: str) -> str:
    """Location of a table Spark derives from source tables, keyed like a cache."""
    digest = hashlib.sha256(key.encode("utf-8")).hexdigest()[:20]
    return f"{ensure_checkpoint_dir(spark)}/tillroll-tables/{name}-{digest}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a job run inside go when it has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _hadoop_fs(spark, path)
    return bool(fs.exists(hpath))


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Length and modification time of a file or directory (metadata only)."""
    fs, hpath = _hadoop_fs(spark, path)
    if not fs.exists(hpath):
        return f"{path}:missing"
    status = fs.getFileStatus(hpath)
    if status.isDirectory():
        total = newest = files = 0
        found = fs.listFiles(hpath, True)  # all levels of a partitioned table
        while found.hasNext():
            child = found.next()
            files += 1
            total += child.getLen()
            newest = max(newest, child.getModificationTime())
        return f"{path}:{files}:{total}:{newest}"
    return f"{path}:{status.getLen()}:{status.getModificationTime()}"


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a directory (metadata only)."""
    fs, hpath = _hadoop_fs(spark, path)
    return int(fs.getContentSummary(hpath).getLength()) if fs.exists(hpath) else 0


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this engine wrote (staging copies)."""
    fs, hpath = _hadoop_fs(spark, path)
    if fs.exists(hpath):
        fs.delete(hpath, True)
