"""Catalogue: Structured Streaming jobs over the event files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablewise.catalog.common import big, plain
from tablewise.catalog.sessions import requests
from tablewise.session import configure, work_folder
from tablewise.sources.tables import read_table
from tablewise.streaming import jobs
from tablewise.streaming.first_event import first_event_windows
from tablewise.streaming.late import split_late

DELAY = "1 day"


def _events(spark, folder):
    configure(spark)
    schema = read_table(spark, folder, "events").schema
    return jobs.file_stream(spark, f"{folder}/events.parquet", schema)


def _timed(spark, folder):
    return jobs.with_event_time(_events(spark, folder), "ts", DELAY)


def _finish(df, name):
    spark = df.sparkSession
    return jobs.run_to_files(df, work_folder(spark, name), work_folder(spark, f"{name}-state"))


def stream_daily_kpis(spark, folder):
    windows = jobs.metric_windows(_timed(spark, folder), "ts", "value", "1 day", "event_type")
    return plain(_finish(windows, "daily"))


def stream_window_changes(spark, folder):
    windows = jobs.metric_windows(_timed(spark, folder), "ts", "value", "1 day", "event_type")
    changes = jobs.compare_windows(_finish(windows, "changes"), "total_value")
    return plain(changes.withColumn("percent_change", F.round("percent_change", 6)))


def stream_rate_flags(spark, folder):
    return plain(_finish(jobs.aligned_limit(_timed(spark, folder), "ts", "user_id", 2, "6 hours"), "limits"))


def _rate_windows(events, spark, **how):
    state = work_folder(spark, "windows-state")
    day = dt.timedelta(days=1)
    return plain(first_event_windows(events, "ts", "user_id", 2, day, day, state, **how))


def stream_rate_windows(spark, folder):
    return _rate_windows(_events(spark, folder), spark)


def _arrivals(spark, folder, arrival, run):
    """The events in three arrivals, each followed by a run of the same job on all that is there."""
    configure(spark)
    events = read_table(spark, folder, "events")
    path = work_folder(spark, "arrivals")
    for number in range(3):
        events.filter(arrival == number).write.mode("append").parquet(path)
        out = run(jobs.file_stream(spark, path, events.schema))
    return out


def stream_late_rows(spark, folder):
    """Rows in time and late rows per type, and how late they came: together they are the input."""
    path, state = work_folder(spark, "late"), work_folder(spark, "late-state")

    def run(stream):
        return split_late(stream, "ts", dt.timedelta(days=20), path, state)

    in_time, late = _arrivals(spark, folder, F.col("event_id") % 3, run)
    counted = in_time.groupBy("event_type").agg(F.count(F.lit(1)).alias("in_time"))
    behind = late.groupBy("event_type").agg(F.count(F.lit(1)).alias("late"), F.min("late_by_us").alias("least_us"), F.max("late_by_us").alias("most_us"))
    return plain(counted.join(behind, "event_type", "full"))


def stream_rate_windows_by_arrival(spark, folder):
    """Limit windows closed by the watermark alone, over events that arrive up to 23 hours out of order."""
    root, state = work_folder(spark, "arrival-windows"), work_folder(spark, "arrival-windows-state")
    day = dt.timedelta(days=1)

    def run(stream):
        return first_event_windows(stream, "ts", "user_id", 2, day, day, state, root, by_successor=False)

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = read_table(spark, folder, "events").agg(F.min(us), F.max(us)).first()
    came = us + F.col("event_id") % 24 * 3_600_000_000
    return plain(_arrivals(spark, folder, F.floor((came - low) / ((high - low + 86_400_000_000) / 3)), run))


def stream_request_log(spark, folder):
    log = requests(_timed(spark, folder))
    return plain(_finish(jobs.request_windows(log, "ts", "1 day"), "requests"))


def stream_alert_dedupe(spark, folder):
    alerts = _events(spark, folder).filter("event_type = 'error'").select(
        "ts", F.concat(F.lit("u"), "user_id").alias("session_id"), F.lit("business_alert_low").alias("event_type"),
        F.lit("Errors seen").alias("title"), F.get_json_object("props", "$.k").alias("message"),
    )
    keys = ("session_id", "event_type", "title", "message")
    return jobs.alerts_once(alerts, work_folder(spark, "alerts"), work_folder(spark, "alerts-state"), keys, time="ts")


def stream_incremental_load(spark, folder):
    texts = _events(spark, folder).select(
        F.concat(F.lit("E"), "event_id").alias("event_id"),
        F.when(F.col("event_id") % 10 == 3, "N/A").otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("event_type"),
        F.when(F.col("event_id") % 11 == 4, "?").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("value"),
        F.col("ts").cast("string").alias("ts"),
    )
    types = {"event_id": "id", "event_type": "category", "value": "currency", "ts": "datetime"}
    loaded = jobs.load_incrementally(
        texts, work_folder(spark, "loaded"), work_folder(spark, "loaded-state"), jobs.cleaned_rows(types), prefix_bits=4
    )
    return plain(loaded.drop("batch_id").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


_CLOSED = "(SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL 1 DAY FROM events)"
_DAILY = f"""
daily AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
  {big("COUNT(*)")} AS events, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_value,
  MIN(value) AS min_value, MAX(value) AS max_value
  FROM events GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED})"""

QUERIES = {
    "stream_daily_kpis": (stream_daily_kpis, "WITH " + _DAILY.strip() + " SELECT * FROM daily"),
    "stream_window_changes": (
        stream_window_changes,
        "WITH " + _DAILY.strip() + """
SELECT event_type, window_start, total_value AS current_value, LAG(total_value) OVER w AS previous_value,
  ROUND((total_value - LAG(total_value) OVER w) / NULLIF(ABS(LAG(total_value) OVER w), 0) * 100, 6) AS percent_change
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY window_start)""",
    ),
    "stream_rate_flags": (
        stream_rate_flags,
        f"""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, user_id, {big("COUNT(*)")} AS requests,
  {big("COUNT(*) - 2")} AS rejected FROM events GROUP BY 1, 2
HAVING COUNT(*) > 2 AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {_CLOSED}""",
    ),
    "stream_rate_windows": (
        stream_rate_windows,
        f"""WITH RECURSIVE w AS (
  SELECT user_id, MIN(ts) AS s FROM events GROUP BY user_id
  UNION ALL
  SELECT w.user_id, MIN(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 1 DAY
  GROUP BY w.user_id, w.s),
ends AS (SELECT user_id, s, LEAD(s) OVER (PARTITION BY user_id ORDER BY s) AS next FROM w),
counted AS (SELECT w.user_id, w.s, w.next, COUNT(*) AS n FROM ends w JOIN events e
  ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts < w.s + INTERVAL 1 DAY GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS user_id, s AS window_start, {big("n")} AS requests,
  {big("GREATEST(0, n - 2)")} AS rejected
FROM counted WHERE next IS NOT NULL OR s + INTERVAL 1 DAY <= {_CLOSED}""",
    ),
    "stream_rate_windows_by_arrival": (
        stream_rate_windows_by_arrival,
        f"""WITH RECURSIVE mark AS (SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL 1 DAY AS t FROM events),
w AS (
  SELECT user_id, MIN(ts) AS s FROM events GROUP BY user_id
  UNION ALL
  SELECT w.user_id, MIN(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 1 DAY
  WHERE w.s + INTERVAL 1 DAY <= (SELECT t FROM mark) GROUP BY w.user_id, w.s)
SELECT CAST(w.user_id AS VARCHAR) AS user_id, s AS window_start, {big("COUNT(*)")} AS requests, {big("GREATEST(0, COUNT(*) - 2)")} AS rejected
FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts < w.s + INTERVAL 1 DAY
WHERE s + INTERVAL 1 DAY <= (SELECT t FROM mark) GROUP BY w.user_id, w.s""",
    ),
    "stream_late_rows": (
        stream_late_rows,
        f"""WITH a AS (SELECT *, event_id % 3 AS arrival FROM events),
newest AS (SELECT arrival, MAX(ts) AS ts FROM a GROUP BY arrival),
marked AS (SELECT a.*, (SELECT date_trunc('milliseconds', MAX(n.ts)) - INTERVAL 20 DAY FROM newest n WHERE n.arrival < a.arrival) AS mark FROM a),
late AS (SELECT event_type, coalesce(ts < mark, false) AS late, epoch_us(mark) - epoch_us(ts) AS by_us FROM marked)
SELECT event_type, {big("COUNT(*) FILTER (NOT late)")} AS in_time, {big("COUNT(*) FILTER (late)")} AS late,
  {big("MIN(by_us) FILTER (late)")} AS least_us, {big("MAX(by_us) FILTER (late)")} AS most_us FROM late GROUP BY event_type""",
    ),
    "stream_request_log": (
        stream_request_log,
        f"""WITH log AS (SELECT date_trunc('day', ts) AS window_start, upper(event_type) AS method,
  regexp_replace('/api/user/' || user_id || '/item/' || json_extract_string(props, '$.k'), '/[0-9]+', '/:id', 'g') AS path,
  CAST(floor((CASE WHEN event_type = 'error' THEN 500 ELSE 200 END + event_id % 5) / 100) AS INT) || 'xx' AS status_class,
  CASE WHEN value / 10 <= 0.5 THEN 'le_0_5' WHEN value / 10 <= 2 THEN 'le_2' ELSE 'gt_2' END AS bucket FROM events)
SELECT *, {big("COUNT(*)")} AS requests FROM log WHERE window_start + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""",
    ),
    "stream_alert_dedupe": (
        stream_alert_dedupe,
        """SELECT DISTINCT 'u' || user_id AS session_id, 'business_alert_low' AS event_type, 'Errors seen' AS title,
  json_extract_string(props, '$.k') AS message FROM events WHERE event_type = 'error'""",
    ),
    "stream_incremental_load": (
        stream_incremental_load,
        """SELECT DISTINCT 'E' || event_id AS event_id,
  CASE WHEN event_id % 10 <> 3 THEN upper(event_type[1]) || lower(event_type[2:]) END AS event_type,
  CASE WHEN event_id % 11 <> 4 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS value, ts FROM events""",
    ),
}
