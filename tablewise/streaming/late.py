"""Rows behind the watermark, kept beside the stream instead of being dropped.

A batch is judged by the watermark that the batches before it left: the largest event time seen, less the allowed delay (to
the millisecond, as Spark keeps it). Rows behind it go to a side table with how far behind they came; the others go on. The
times of a batch are one small row in ``seen``, so a batch that is run again is judged alike.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEEN = "newest_us bigint, batch_id int"


class Watermarks:
    """The largest event time of every batch, and the watermarks that follow."""

    def __init__(self, spark: SparkSession, root: str, delay: dt.timedelta):
        self.spark, self.path, self.delay = spark, f"{root.rstrip('/')}/seen", delay

    def _newest(self, before: int) -> int | None:
        try:
            seen = self.spark.read.schema(_SEEN).parquet(self.path)
        except AnalysisException:  # the first batch
            return None
        return seen.filter(F.col("batch_id") < before).agg(F.max("newest_us")).first()[0]

    def at_start(self, batch_id: int) -> int | None:
        """The watermark (microseconds) that judges a batch; none before the first."""
        newest = self._newest(batch_id)
        return None if newest is None else self.of(newest)

    def of(self, newest_us: int) -> int:
        return newest_us // 1000 * 1000 - self.delay // dt.timedelta(microseconds=1)

    def note(self, batch_id: int, newest_us: int | None) -> int | None:
        """Keep a batch's largest time; the watermark after it."""
        row = self.spark.createDataFrame([(newest_us, batch_id)], _SEEN).coalesce(1)
        writer = row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch_id").parquet(self.path)
        return self.at_start(batch_id + 1)


def split_late(stream: DataFrame, time: str, delay: dt.timedelta, path: str, checkpoint: str, work: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a stream to its end; the rows in time (handed to ``work`` batch by batch as well) and the late ones, with
    ``late_by_us``: how far behind the watermark they are. A row without a time is in time."""
    spark = stream.sparkSession
    marks = Watermarks(spark, f"{path}/marks", delay)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    on_time_schema = T.StructType([*stream.schema, T.StructField("batch_id", T.IntegerType())])
    late_schema = T.StructType([*stream.schema, T.StructField("late_by_us", T.LongType()), T.StructField("batch_id", T.IntegerType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = marks.at_start(batch_id)
        behind = F.lit(False) if mark is None else F.coalesce(us < mark, F.lit(False))
        batch = batch.persist()
        in_time = batch.filter(~behind)
        late = batch.filter(behind).withColumn("late_by_us", F.lit(mark or 0) - us)
        for rows, name in ((in_time, "in_time"), (late, "late")):
            rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")
        if work:
            work(in_time, batch_id)
        marks.note(batch_id, batch.agg(F.max(us)).first()[0])
        batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return (
        spark.read.schema(on_time_schema).parquet(f"{path}/in_time").drop("batch_id"),
        spark.read.schema(late_schema).parquet(f"{path}/late").drop("batch_id"),
    )
