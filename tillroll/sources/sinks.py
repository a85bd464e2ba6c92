"""Writers (S5, S6, S9).  Each is a distributed write: tasks write their own
part files and the job commits them; a lost executor only re-runs its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed

# Tables that are written to be read again: smaller than with Spark's default codec.
COMPRESSION = "zstd"


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Store a (cleaned) table as parquet.  Never pass the path being read."""
    writer = df.write.mode(mode).option("compression", COMPRESSION)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Rows as CSV with a header, no index column."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd")
       .csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines, one object per row; null fields are written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def as_json(df: DataFrame) -> DataFrame:
    """S9 in a column: each row as one JSON text (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))
