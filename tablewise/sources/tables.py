"""Readers for the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewise.session import configure


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
