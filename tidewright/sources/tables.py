"""Typed access to the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the clock as integer microseconds; instants carry no zone, so they are read as UTC."""
    return table(spark, sf_dir, "events").withColumn(
        "t_us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    )
