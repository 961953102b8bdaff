"""Limit windows that open at a client's first event and reopen at the first event after they end.

Each window depends on the one before it, but no client has to meet in one task. Events are counted per (client, time); a
time's successor is the client's first time at or after the end of the window that it would open. The successors
of all times are found side by side, and the times that really open a window are those on the way from the client's first
one: the ways are followed by doubling (the second, fourth, eighth successor and so on), so a chain of k windows takes
log2(k) joins on (client, time).

Times are cut into slices of an eighth of a window. What depends on the order of a client's times is settled inside a
(client, slice), and carried over slices by a window over one row per slice: their number follows from
the time that a client was active, not from its events.

Between batches only the counts from the start of each client's open window on are kept, as a table per batch, so a
batch that is run again finds what it found.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.session import stage, work_folder
from tablewise.streaming.late import Watermarks

_PENDING = "client string, us bigint, n bigint, batch_id int"
_OUT = "client string, start_us bigint, requests bigint, batch_id int"
SLICES = 8  # of a window


def _slice(us: Column, length: int) -> Column:
    return F.floor(us / F.lit(max(1, length // SLICES)))


def with_successors(counts: DataFrame, length: int) -> DataFrame:
    """client, us, next (the first time at or after us + length, if any), before (events before us) and upto (events
    before us + length) of every (client, us, n)."""
    events = counts.select("client", "us", "n", F.lit(None).cast("long").alias("asked_by"))
    asked = counts.select("client", (F.col("us") + length).alias("us"), F.lit(0).cast("long").alias("n"), F.col("us").alias("asked_by"))
    rows = events.unionByName(asked).withColumn("slice", _slice(F.col("us"), length))
    event = F.col("asked_by").isNull()

    # one row per client and slice: its first event, its events, and both carried over slices
    slices = rows.groupBy("client", "slice").agg(F.min(F.when(event, F.col("us"))).alias("first"), F.sum("n").alias("n"))
    order, back = Window.partitionBy("client").orderBy("slice"), Window.partitionBy("client").orderBy(F.desc("slice"))
    past = (Window.unboundedPreceding, -1)  # frames that grow by a row are kept up as they go
    slices = slices.select(
        "client", "slice",
        F.last("first", ignorenulls=True).over(back.rowsBetween(*past)).alias("later"),
        F.coalesce(F.sum("n").over(order.rowsBetween(*past)), F.lit(0)).alias("carried"),
    )

    # inside a slice a question comes before an event of its time, which answers it
    inside = Window.partitionBy("client", "slice").orderBy("us", event.cast("int"))
    inside_back = Window.partitionBy("client", "slice").orderBy(F.desc("us"), event.cast("int").desc())
    found = rows.withColumns({
        "here": F.last(F.when(event, F.col("us")), ignorenulls=True).over(inside_back.rowsBetween(*past)),
        "earlier": F.coalesce(F.sum("n").over(inside.rowsBetween(*past)), F.lit(0)),
    }).join(slices, ["client", "slice"])
    found = found.select("client", "us", "asked_by", F.coalesce("here", "later").alias("next"), (F.col("carried") + F.col("earlier")).alias("events"))
    return found.groupBy("client", F.coalesce("asked_by", "us").alias("us")).agg(
        F.max(F.when(~event, F.col("next"))).alias("next"),
        F.max(F.when(event, F.col("events"))).alias("before"),
        F.max(F.when(~event, F.col("events"))).alias("upto"),
    )


def openings(linked: DataFrame) -> DataFrame:
    """The rows of ``linked`` (client, us, next, ...) on the way from each client's first time."""
    linked = stage(linked, "windows-linked")
    first = linked.groupBy("client").agg(F.min("us").alias("us"))
    reached = stage(first, "windows-reached")
    jumps = linked.filter("next is not null").select("client", "us", F.col("next").alias("to"))
    while not jumps.isEmpty():
        more = reached.join(jumps, ["client", "us"]).select("client", F.col("to").alias("us"))
        reached = stage(reached.unionByName(more), "windows-reached")
        ahead = jumps.select("client", F.col("us").alias("to"), F.col("to").alias("further"))
        jumps = stage(jumps.join(ahead, ["client", "to"]).select("client", "us", F.col("further").alias("to")), "windows-jumps")
    return linked.join(reached, ["client", "us"], "left_semi")


class FirstEventWindows:
    """The fold over batches: counts that are still open, in a table per batch."""

    def __init__(self, stream: DataFrame, root: str, length: dt.timedelta, delay: dt.timedelta, by_successor: bool):
        self.spark, self.root, self.by_successor = stream.sparkSession, root.rstrip("/"), by_successor
        self.length = length // dt.timedelta(microseconds=1)
        self.marks = Watermarks(self.spark, f"{self.root}/marks", delay)

    def _pending(self, batch_id: int) -> DataFrame:
        try:
            stored = self.spark.read.schema(_PENDING).parquet(f"{self.root}/pending")
        except AnalysisException:  # the first batch
            return self.spark.createDataFrame([], "client string, us bigint, n bigint")
        return stored.filter(F.col("batch_id") == batch_id - 1).select("client", "us", "n")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        writer = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch_id").parquet(f"{self.root}/{name}")

    def batch(self, events: DataFrame, batch_id: int) -> None:
        """Fold a batch of (client, us) in (rows without either take no part): closed windows and what stays open are written."""
        fresh = events.filter("us is not null and client is not null").groupBy("client", "us").agg(F.count(F.lit(1)).alias("n"))
        kept = self._pending(batch_id)
        mark = self.marks.at_start(batch_id)
        if mark is not None:
            fresh = fresh.filter(F.col("us") >= mark)
        if self.by_successor:  # an open window takes what comes before its start
            opened = kept.groupBy("client").agg(F.min("us").alias("opened"))
            fresh = fresh.join(opened, "client", "left").select("client", F.greatest("us", "opened").alias("us"), "n")
        counts = stage(kept.unionByName(fresh).groupBy("client", "us").agg(F.sum("n").alias("n")), "windows-counts")
        mark = self.marks.note(batch_id, counts.agg(F.max("us")).first()[0])  # what is kept is no newer than what was noted
        windows = openings(with_successors(counts, self.length))
        closed = F.lit(False) if mark is None else F.col("us") + self.length <= mark
        if self.by_successor:
            closed = closed | F.col("next").isNotNull()
        windows = stage(windows.withColumn("closed", closed), "windows-found")
        # windows close in order, so what is open begins at the client's first open window
        begins = windows.filter(~F.col("closed")).groupBy("client").agg(F.min("us").alias("begin"))
        out = windows.filter("closed").select("client", F.col("us").alias("start_us"), (F.col("upto") - F.col("before")).alias("requests"))
        self._write(out, "windows", batch_id)
        self._write(counts.join(begins, "client").filter(F.col("us") >= F.col("begin")).select("client", "us", "n"), "pending", batch_id)

    def result(self) -> DataFrame:
        return self.spark.read.schema(_OUT).parquet(f"{self.root}/windows").drop("batch_id")


def first_event_windows(
    events: DataFrame, time: str, client: str, limit: int, length: dt.timedelta, delay: dt.timedelta,
    checkpoint: str, root: str | None = None, by_successor: bool = True,
) -> DataFrame:
    """Run a stream of events to its end: client, window_start, requests, rejected of every closed window.

    A window closes when the watermark passes its end, and with ``by_successor`` also when a later event is seen; without
    it the result does not depend on how events in time fall into batches. Later runs on the same folders go on from there.
    """
    root = root or work_folder(events.sparkSession, "first-event-windows")
    fold = FirstEventWindows(events, root, length, delay, by_successor)
    rows = events.select(F.col(client).cast("string").alias("client"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    query = rows.writeStream.foreachBatch(fold.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    start = F.timestamp_micros("start_us").alias("window_start")
    rejected = F.greatest(F.lit(0).cast("long"), F.col("requests") - limit).alias("rejected")
    return fold.result().select(F.col("client").alias(client), start, "requests", rejected)
