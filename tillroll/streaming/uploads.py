"""Uploads as a stream: every CSV that lands in a folder is ingested once.

Structured Streaming tracks which files were seen (in its checkpoint), so
each new file is processed exactly once across restarts.  The binary-file
source lists the files; only their paths are selected, so file contents
are never read by the stream itself.  Each micro-batch (at most
``max_files`` paths) runs the batch ingest gate per file.  A file that cannot be
ingested is listed with its error and does not stop the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import ingest
from ..sources import catalog


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def start_upload_stream(spark: SparkSession, landing_dir: str, catalog_root: str, out_root: str,
                        checkpoint: str, max_files: int = 1, once: bool = False):
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", max_files).load(landing_dir).select("path"))

    def process(batch: DataFrame, epoch_id: int) -> None:
        # A batch that failed after registering is replayed with the same epoch id: an output that the
        # catalog names is skipped, so a replay never registers an upload twice.
        for row in batch.collect():  # at most max_files paths
            path = row["path"]
            name = path.rstrip("/").rsplit("/", 1)[-1]
            out = f"{out_root.rstrip('/')}/{epoch_id}-{name}.parquet"
            if catalog.datasets(spark, catalog_root).where(F.col("path") == out).isEmpty():
                try:
                    ingest(spark, path, catalog_root, out, name)
                except Exception as error:  # as in the original, any error rejects the upload and the next one goes on
                    catalog.reject(spark, catalog_root, name, path, error)

    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()
