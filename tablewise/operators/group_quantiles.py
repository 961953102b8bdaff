"""Exact quantiles of every group at once, however many groups there are and however large one is.

Each order statistic of each group lies in a bracket of values, at first from the group's smallest to its largest. A round
counts all brackets' values in ``BINS`` equal steps, keeps the smallest and largest value of each step, and replaces a
bracket by the step that holds the statistic. Counts are combined before they are shuffled, so a group with most of the rows
costs ``BINS`` rows per task. Brackets of at most ``limit`` values are ordered directly; equal ends end one at once. As a
step's own ends are its bracket, far outliers cost one round, whatever the distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.session import stage

BINS = 1024
LIMIT = 2_000  # values of a bracket that are ordered in one task


def _bracketed(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """g, v, low, high of the values that lie in a bracket of their group (brackets of a group are apart)."""
    ends = brackets.groupBy("g").agg(F.collect_set(F.struct("low", "high")).alias("ends"))  # a few for each probability
    inside = F.filter("ends", lambda e: F.col("v").between(e["low"], e["high"]))
    return values.join(ends, "g").select("g", "v", F.explode(inside).alias("e")).select("g", "v", "e.low", "e.high")


def _step(low: Column, high: Column, v: Column) -> Column:
    """Number of the step a value lies in; halves keep the width finite."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))


def _refined(values: DataFrame, wide: DataFrame) -> DataFrame:
    inside = _bracketed(values, wide)
    steps = inside.groupBy("g", "low", "high", _step(F.col("low"), F.col("high"), F.col("v")).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last")
    )
    order = Window.partitionBy("g", "low", "high").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    hit = (F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("before") + F.col("n"))
    found = wide.select("g", "rank", "low", "high", "offset").join(steps, ["g", "low", "high"]).filter(hit)
    return found.select(
        "g", "rank", F.col("first").alias("low"), F.col("last").alias("high"),
        (F.col("offset") - F.col("before")).alias("offset"), F.col("n").alias("size"),
    )


def _ordered(values: DataFrame, small: DataFrame) -> DataFrame:
    """The statistics of brackets of few values. Rows are dealt once, by group, and only their sort takes memory: the brackets,
    few for each group, are met by hash on both sides of it."""
    wanted = small.groupBy("g").agg(F.collect_list(F.struct("low", "high", "rank", "offset")).alias("wanted")).hint("shuffle_hash")
    inside = F.filter("wanted", lambda e: F.col("v").between(e["low"], e["high"]))
    lows = F.array_distinct(F.transform(inside, lambda e: e["low"]))  # brackets of a group are apart
    held = values.join(wanted, "g").select("g", "v", F.explode(lows).alias("low"))
    place = F.row_number().over(Window.partitionBy("g", "low").orderBy("v")) - 1
    placed = held.withColumn("place", place).join(wanted, "g")
    hit = F.filter("wanted", lambda e: (e["low"] == F.col("low")) & (e["offset"] == F.col("place")))
    return placed.select("g", F.col("v").alias("value"), F.explode(hit).alias("e")).select("g", "e.rank", "value")


def group_quantiles(df: DataFrame, group: Column, value: Column, probabilities: Sequence[float], limit: int = LIMIT) -> DataFrame:
    """g, count and q0, q1, ... (linear interpolation) of every group; rows without a group or a value are left out."""
    values = df.select(group.alias("g"), value.cast("double").alias("v"))
    values = values.filter(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0))
    facts = stage(values.groupBy("g").agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("low"), F.max("v").alias("high")), "group-facts")
    places = F.array(*[F.lit(float(p)) * (F.col("count") - 1) for p in probabilities])
    whole = [F.transform(places, lambda p: F.floor(p)), F.transform(places, lambda p: F.ceil(p))]
    ranks = F.array_distinct(F.concat(*whole))
    brackets = facts.select("g", F.explode(ranks).alias("rank"), "low", "high", F.col("count").alias("size"))
    brackets = stage(brackets.withColumn("offset", F.col("rank")), "group-brackets")
    done = []
    while True:
        same = F.col("low") == F.col("high")
        done.append(brackets.filter(same).select("g", "rank", F.col("low").alias("value")))
        done.append(_ordered(values, brackets.filter(~same & (F.col("size") <= limit))))
        wide = brackets.filter(~same & (F.col("size") > limit))
        if wide.isEmpty():
            break
        brackets = stage(_refined(values, wide), "group-brackets")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    by_rank = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = facts.select("g", "count").join(by_rank, "g")
    columns = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("count") - 1)
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        columns.append((low + (high - low) * (place - F.floor(place))).alias(f"q{i}"))
    return out.select("g", "count", *columns)

