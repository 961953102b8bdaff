"""What the operators share: clashing column names, staged tables, the tokenizer's text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tablewise.session import stage, work_folder

__all__ = ["documents", "stage", "without", "work_folder"]


ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 16 << 20


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    """A table of texts, which go to Python in batches of bounded rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of a frame that no output column of an operator replaces (names compare without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
