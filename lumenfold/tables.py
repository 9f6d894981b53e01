"""Readers for the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lumenfold.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; zone-less timestamps are read as UTC instants (session zone UTC)."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def iso(col: str):
    """Timestamp rendered the same way in Spark and in DuckDB."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
