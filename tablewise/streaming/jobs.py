"""Structured Streaming jobs: incremental loads, metric rollups, limits and alerts.

Every job runs over whatever files have arrived (``availableNow``) and can be started again
from its checkpoint; sinks are idempotent, so a repeated micro-batch changes nothing. State is
bounded by the watermark. ``max_files`` bounds the size of a micro-batch. Windows that open at a client's first event are
in :mod:`tablewise.streaming.first_event`, rows behind the watermark in :mod:`tablewise.streaming.late`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import AMOUNT, duration_bucket, templated_path
from tablewise.operators.kpi import Types
from tablewise.streaming.digests import DigestIndex


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files: int | None = None,
    **options,
) -> DataFrame:
    """``path`` may be a folder that files arrive in or a single file; the file source takes a
    folder or a pattern, so the last letter is given as a pattern of itself."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    return reader.load(f"{path[:-1]}[{path[-1]}]")


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need a time-zoned timestamp; Parquet without a zone loads as ``timestamp_ntz``."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode query to the end of the input and read its (exactly-once) output."""
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path)


def late_rows(query) -> int:
    """Rows dropped because they came after the watermark, from the progress of a query."""
    progress = query.recentProgress
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p.get("stateOperators", []))


def load_incrementally(
    stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], prefix_bits: int = 8
) -> DataFrame:
    """Clean and store every arriving file once; a repeated batch overwrites its own partition.

    Whole-row duplicates are left out across batches by their SHA-256, looked up in an index beside the
    checkpoint (:mod:`tablewise.streaming.digests`), so the result does not depend on how files fall into batches and the stream
    itself keeps no state."""
    spark = stream.sparkSession
    index = DigestIndex(spark, f"{checkpoint.rstrip('/')}-digests", prefix_bits)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = index.without_known(batch, batch_id).persist()
        prepared = prepare(new.drop("__digest", "__prefix")).withColumn("batch_id", F.lit(batch_id))
        writer = prepared.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch_id").parquet(path)
        index.add(new, batch_id)
        new.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def metric_windows(
    events: DataFrame, time: str, value: str, length: str, *keys: str
) -> DataFrame:
    """Count, sum, smallest and largest value per tumbling window (and key); partial aggregates
    collapse hot windows before the shuffle."""
    amount = F.col(value).cast(AMOUNT)
    return (
        events.groupBy(F.window(time, length).alias("w"), *keys)
        .agg(
            F.count("*").alias("events"),
            F.sum(amount).alias("total_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                "events", "total_value", "min_value", "max_value")
    )


def aligned_limit(events: DataFrame, time: str, client: str, limit: int, length: str) -> DataFrame:
    """Clients beyond the limit per clock-aligned window. Counts are pre-combined, so a client
    with a large part of all events costs one row per map task."""
    counts = events.groupBy(F.window(time, length).alias("w"), client).agg(F.count("*").alias("requests"))
    return counts.filter(F.col("requests") > limit).select(
        F.col("w.start").alias("window_start"), client, "requests", (F.col("requests") - limit).alias("rejected")
    )


def request_windows(requests: DataFrame, time: str, length: str) -> DataFrame:
    """Request counts per window, method, path template, status class and duration bucket."""
    return (
        requests.groupBy(F.window(time, length).alias("w"), *request_keys())
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), *REQUEST_KEYS, "requests")
    )


REQUEST_KEYS = ("method", "path", "status_class", "bucket")


def request_keys() -> list[Column]:
    status = F.concat((F.col("status") / 100).cast("int").cast("string"), F.lit("xx"))
    return [
        F.col("method"),
        templated_path(F.col("path")).alias("path"),
        status.alias("status_class"),
        duration_bucket(F.col("seconds")).alias("bucket"),
    ]


def request_rollup(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*request_keys()).agg(F.count("*").alias("requests"))


def alerts_once(
    alerts: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], time: str | None = None, expiry: str = "400 days"
) -> DataFrame:
    """Append each distinct alert once until ``expiry`` after it came, by its ``time`` or else by when it arrived.

    The stream keeps one time per alert as state and drops it when the watermark has passed, so a batch reads
    neither the alerts written before nor state that grows for ever; a repeated batch overwrites its own files."""
    event_time = F.current_timestamp() if time is None else F.col(time).cast("timestamp")
    timed = alerts.withColumn("__at", event_time).select(*keys, "__at").withWatermark("__at", expiry)
    once = timed.dropDuplicatesWithinWatermark(list(keys)).drop("__at")
    schema = once.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    query = (
        once.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return alerts.sparkSession.read.schema(T.StructType([*schema, T.StructField("batch_id", T.IntegerType())])).parquet(path).drop("batch_id")


def compare_windows(windows: DataFrame, measure: str) -> DataFrame:
    """Each closed window against the one before it, per key (windows are few per key)."""
    from pyspark.sql import Window

    from tablewise.functions.columns import percent_change

    keys = [c for c in ("event_type",) if c in windows.columns]
    before = F.lag(measure).over(Window.partitionBy(*keys).orderBy("window_start"))
    value = F.col(measure).cast("double")
    return windows.withColumn("previous", before.cast("double")).select(
        *keys, "window_start", value.alias("current_value"), F.col("previous").alias("previous_value"),
        percent_change(value, F.col("previous")).alias("percent_change"),
    )


def cleaned_rows(types: Types) -> Callable[[DataFrame], DataFrame]:
    """Row-level cleaning for arriving batches (statistics-based steps need the whole table)."""
    from tablewise.operators import clean

    def prepare(batch: DataFrame) -> DataFrame:
        rows = clean.coerce_numbers(clean.null_tokens(batch), types)
        rows = clean.drop_missing_ids(clean.drop_duplicates(rows), types)
        return clean.title_categories(clean.strip_text(clean.parse_dates(rows, types)), types)

    return prepare
