"""Session metadata as Parquet tables partitioned by session, and questions over it.

Plain Parquet has no row updates, so state changes are appended as events and the latest
state is an aggregate (``max_by``); snapshots of one session are replaced by overwriting its
partition.

The log of status events is kept in generations. :meth:`MetadataStore.compact` (once a day, say) opens the next one and writes a snapshot of
all that are closed for a whole round already, so that a slow writer of the last one loses nothing: of each session
the few events that still decide its state. The manifest, one row per compaction, says which generation is open and where the
log begins behind the snapshot; reading takes the snapshot and the log from there on, whatever came before.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


STATUS_EVENTS = (
    "session_id string, event_at timestamp, event_no long, status string, total_files long,"
    " total_rows long, error_message string, completed_at timestamp, session_name string"
)
SCHEMAS = {
    "status_events": STATUS_EVENTS,
    "uploaded_files": (
        "session_id string, original_filename string, table_name string, file_size_bytes long,"
        " row_count long, column_count long, encoding string, uploaded_at timestamp"
    ),
    "schema_profiles": (
        "session_id string, table_name string, column_name string, detected_type string, null_count long,"
        " null_percent double, unique_count long, sample_values array<string>, column_order long"
    ),
    "detected_relationships": (
        "session_id string, from_table string, from_column string, to_table string, to_column string,"
        " confidence string, match_percent double, view_name string"
    ),
    "quality_reports": (
        "session_id string, table_name string, quality_score long, total_rows long, duplicate_rows long,"
        " columns_with_nulls long, outlier_columns long, issues_found array<string>,"
        " actions_taken array<string>, generated_at timestamp"
    ),
    "kpi_results": (
        "session_id string, kpi_name string, kpi_value double, kpi_unit string, kpi_category string,"
        " display_format string, tier int, confidence double, calculated_at timestamp"
    ),
    "chart_configs": (
        "session_id string, chart_type string, chart_title string, source_table string, x_column string,"
        " y_column string, group_by_column string, aggregation string, chart_order long, rationale string"
    ),
    "insights": (
        "session_id string, insight_type string, chart_order long, insight_text string,"
        " generated_at timestamp"
    ),
    "notifications": (
        "session_id string, event_type string, title string, message string, created_at timestamp"
    ),
    "notification_reads": "session_id string, read_at timestamp",
}
MANIFEST = "open int, begins int"
NOTICE_KEYS = ("session_id", "event_type", "title", "message")


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class MetadataStore:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # ---- generations of the status log ----

    def _manifest(self) -> tuple[int, int]:
        """The open generation, and the first one that is not in the snapshot."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(self.path("status_manifest"))
        except AnalysisException:  # a store without a compaction
            return 0, 0
        newest = rows.agg(F.max(F.struct("open", "begins")).alias("m")).first()["m"]
        return (newest["open"], newest["begins"]) if newest else (0, 0)

    def _generation(self, number: int) -> str:
        return f"{self.path('status_events')}/generation={number}"

    def _open(self, number: int) -> None:
        """A generation's folder, so that it can be read before its first event."""
        empty = self.spark.createDataFrame([], STATUS_EVENTS)
        empty.write.mode("append").partitionBy("session_id").parquet(self._generation(number))

    def _status_log(self, without_open: bool = False) -> DataFrame:
        open_, begins = self._manifest()
        schema = T.StructType.fromDDL(STATUS_EVENTS)
        names = schema.fieldNames()
        log = [self.spark.read.schema(schema).parquet(self._generation(g)).select(*names) for g in range(begins, open_ + (not without_open))]
        if begins:
            log.append(self.spark.read.schema(schema).parquet(f"{self.path('status_snapshots')}/begins={begins}").select(*names))
        return reduce(lambda a, b: a.unionByName(b), log)

    def compact(self) -> None:
        """Open the next generation and write the snapshot of those that were closed before this round."""
        open_, _ = self._manifest()
        if open_:  # the generation that is open now may still get an event of a slow writer
            snapshot = deciding(self._status_log(without_open=True))
            snapshot.write.mode("overwrite").parquet(f"{self.path('status_snapshots')}/begins={open_}")
        self._open(open_ + 1)
        row = self.spark.createDataFrame([(open_ + 1, open_)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(self.path("status_manifest"))

    def _shaped(self, table: str, df: DataFrame) -> DataFrame:
        fields = T.StructType.fromDDL(SCHEMAS[table]).fields
        stamp = F.lit(now()).cast("timestamp")

        def column(f: T.StructField) -> Column:
            if f.name in df.columns:
                return F.col(f.name).cast(f.dataType).alias(f.name)
            stamped = f.name in ("generated_at", "calculated_at", "created_at", "uploaded_at")
            return (stamp if stamped else F.lit(None)).cast(f.dataType).alias(f.name)

        return df.select(*(column(f) for f in fields))

    def create(self) -> MetadataStore:
        """Empty tables, so that reading works before the first write."""
        self._open(0)
        for table, schema in SCHEMAS.items():
            if table == "status_events":
                continue
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("append").partitionBy("session_id").parquet(self.path(table))
        return self

    def append(self, table: str, df: DataFrame) -> None:
        path = self._generation(self._manifest()[0]) if table == "status_events" else self.path(table)
        self._shaped(table, df).write.mode("append").partitionBy("session_id").parquet(path)

    def replace(self, table: str, df: DataFrame, session_id: str) -> None:
        """Replace one session's rows in one pass over them. A row of nulls, which :meth:`read` skips,
        keeps the partition of an empty snapshot."""
        shaped = self._shaped(table, df.withColumn("session_id", F.lit(session_id)))
        nulls = (None,) * (len(shaped.columns) - 1)
        shaped = shaped.unionAll(self.spark.createDataFrame([(session_id, *nulls)], T.StructType.fromDDL(SCHEMAS[table])))
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("session_id").parquet(self.path(table))

    def read(self, table: str, session_id: str | None = None) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[table])
        if table == "status_events":
            df = self._status_log()
        else:
            df = self.spark.read.schema(schema).parquet(self.path(table)).select(*schema.fieldNames())
        others = [F.col(c).isNotNull() for c in schema.fieldNames() if c != "session_id"]
        filled = others[0]
        for test in others[1:]:
            filled = filled | test
        df = df.filter(filled)
        return df if session_id is None else df.filter(F.col("session_id") == session_id)

    # ---- sessions ----

    def set_status(self, session_id: str, status: str, **facts) -> None:
        row = {
            "session_id": session_id, "event_at": now(), "event_no": time.time_ns(), "status": status,
            "total_files": 0, "total_rows": 0, "error_message": None, "completed_at": None, "session_name": None,
        } | facts
        fields = T.StructType.fromDDL(STATUS_EVENTS).fieldNames()
        self.append("status_events", self.spark.createDataFrame([tuple(row[f] for f in fields)], STATUS_EVENTS))

    def rename(self, session_id: str, name: str) -> None:
        if not name.strip():
            raise ValueError("a session's name must not be blank")
        self.set_status(session_id, None, session_name=name.strip())

    def sessions(self) -> DataFrame:
        return latest_sessions(self.read("status_events"))

    def status(self, session_id: str) -> DataFrame:
        return latest_sessions(self.read("status_events", session_id))

    def session_list(self, k: int | None = None) -> DataFrame:
        return session_list(self.sessions(), self.read("uploaded_files"), k)

    # ---- notifications ----

    def notify(self, session_id: str, notices: DataFrame) -> None:
        self.append("notifications", notices.withColumn("session_id", F.lit(session_id)))

    def notify_once(self, session_id: str, notices: DataFrame) -> None:
        keyed = notices.withColumn("session_id", F.lit(session_id)).select(*NOTICE_KEYS)
        self.append("notifications", unseen(keyed, self.read("notifications", session_id)))

    def mark_read(self, session_id: str) -> None:
        self.append(
            "notification_reads", self.spark.createDataFrame([(session_id, now())], SCHEMAS["notification_reads"])
        )

    def notifications(self, session_id: str, k: int | None = None) -> DataFrame:
        read_until = self.read("notification_reads", session_id).agg(F.max("read_at").alias("t")).scalar()
        listed = (
            self.read("notifications", session_id)
            .withColumn("read", F.coalesce(F.col("created_at") <= read_until, F.lit(False)))
            .orderBy(F.desc("created_at"), F.desc("title"))
        )
        return listed if k is None else listed.limit(k)

    def insight_history(self, session_id: str) -> DataFrame:
        mine = self.read("insights", session_id).filter("insight_type = 'chart_insight'")
        return mine.orderBy("chart_order").select("chart_order", "insight_text", "generated_at")


def unseen(new: DataFrame, old: DataFrame, keys=NOTICE_KEYS) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``old`` yet, each once."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti")


def deciding(events: DataFrame) -> DataFrame:
    """The events that decide what :func:`latest_sessions` says, at most five of a session."""
    order = F.struct("event_at", "event_no")
    whole = F.struct(*T.StructType.fromDDL(STATUS_EVENTS).fieldNames())

    def last(test: Column) -> Column:
        return F.max_by(F.when(test, whole), F.when(test, order))

    kept = F.array(
        last(F.col("status").isNotNull()), last(F.col("total_files") > 0), last(F.col("total_rows") > 0),
        last(F.col("session_name").isNotNull()), F.min_by(whole, order),
    )
    found = events.groupBy("session_id").agg(F.array_distinct(F.array_compact(kept)).alias("kept"))
    return found.select(F.explode("kept").alias("e")).select("e.*")


def latest_sessions(events: DataFrame) -> DataFrame:
    """The current state per session from its event log: last status, last counts above zero,
    last name given. One aggregation with map-side combine."""
    order = F.struct("event_at", "event_no")

    def last(column: str, test: Column) -> Column:
        return F.max_by(F.when(test, F.col(column)), F.when(test, order)).alias(column)

    stated = F.col("status").isNotNull()
    return events.groupBy("session_id").agg(
        last("status", stated),
        F.coalesce(last("total_files", F.col("total_files") > 0), F.lit(0)).alias("total_files"),
        F.coalesce(last("total_rows", F.col("total_rows") > 0), F.lit(0)).alias("total_rows"),
        last("error_message", stated),
        last("completed_at", stated),
        last("session_name", F.col("session_name").isNotNull()),
        F.min("event_at").alias("created_at"),
    )


def session_list(sessions: DataFrame, files: DataFrame, k: int | None = None) -> DataFrame:
    """The newest sessions with file counts and a default name."""
    per_session = files.groupBy("session_id").agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("file_rows"),
        F.min_by("original_filename", F.struct("uploaded_at", "original_filename")).alias("first_file"),
    )
    short = F.concat(F.lit("Dataset "), F.substring("session_id", 1, 8))
    listed = (
        sessions.join(per_session, "session_id", "left")
        .select(
            "session_id",
            F.coalesce(F.nullif("session_name", F.lit("")), short).alias("name"),
            "status", "total_files",
            F.greatest(F.coalesce("total_rows", F.lit(0)), F.coalesce("file_rows", F.lit(0))).alias("total_rows"),
            "created_at", F.coalesce("file_count", F.lit(0)).alias("file_count"), "first_file",
        )
        .orderBy(F.desc("created_at"), "session_id")
    )
    return listed if k is None else listed.limit(k)


