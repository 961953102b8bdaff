"""Chart data as long frames: ``x`` (text or period), an optional ``grp`` and ``value``.

Each builder aggregates before it limits, so only chart points leave the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import rules
from tablewise.functions.columns import exact_amount, is_text, month_of, ratio, real, to_moment
from tablewise.operators.filters import DashboardFilters, apply_filters
from tablewise.operators.group_quantiles import LIMIT, group_quantiles
from tablewise.operators.moments import correlations
from tablewise.operators.quantiles import REST, exact_quantiles


@dataclass(frozen=True)
class ChartSpec:
    chart_type: str
    chart_title: str
    source_table: str
    x_column: str
    y_column: str | None = None
    group_by_column: str | None = None
    aggregation: str = "sum"
    rationale: str = ""
    priority: int = 5
    chart_order: int = 0


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _aggregate(kind: str) -> Column:
    return {
        "sum": F.sum("y").cast("double"),
        "avg": ratio(F.sum("y"), F.count("y")),
    }.get(kind, F.count("y").cast("double")).alias("value")


def _y(df: DataFrame, column: str) -> Column:
    return exact_amount(_col(column), df.schema[column].dataType).alias("y")


def line(df: DataFrame, x: str, y: str, group: str | None = None, aggregation: str = "sum") -> DataFrame:
    """Monthly points in time order, all of them."""
    moment = to_moment(_col(x)) if is_text(df.schema[x].dataType) else _col(x)
    amount = F.lit(1).alias("y") if aggregation == "count" else _y(df, y)
    rows = df.filter(_col(x).isNotNull() & _col(y).isNotNull()).select(
        month_of(moment).alias("x"), *([_col(group).cast("string").alias("grp")] if group else []), amount
    )
    keys = ["x", "grp"] if group else ["x"]
    return rows.groupBy(*keys).agg(_aggregate(aggregation)).orderBy(*keys)


def top_groups(
    df: DataFrame, x: str, y: str | None = None, aggregation: str = "sum", k: int | None = None
) -> DataFrame:
    """All groups, largest first, or the k largest where a report asks for that many."""
    rows = df.filter(_col(x).isNotNull()).select(
        _col(x).cast("string").alias("x"), _y(df, y) if y else F.lit(1).alias("y")
    )
    grouped = rows.filter(F.col("y").isNotNull()).groupBy("x").agg(_aggregate(aggregation if y else "count"))
    ranked = grouped.orderBy(F.desc("value"), "x")
    return ranked if k is None else ranked.limit(k)


def bar(df, x, y=None, aggregation="sum", k=None):
    return top_groups(df, x, y, aggregation, k)


def treemap(df, x, y=None, k=None):
    return top_groups(df, x, y, "sum", k)


def funnel(df, x, y=None, k=None):
    return top_groups(df, x, y, "sum", k)


def pie(df: DataFrame, x: str, slices: int | None = None) -> DataFrame:
    """All values; with ``slices``, one less than so many and the sum of the rest as ``Other``."""
    if slices is None:
        return top_groups(df, x)
    head = top_groups(df, x, k=slices - 1)
    counts = df.filter(_col(x).isNotNull()).agg(F.count("*").cast("double").alias("n"))
    rest = head.agg((counts.scalar() - F.coalesce(F.sum("value"), F.lit(0.0))).alias("value"))
    return head.unionByName(rest.filter("value > 0").select(F.lit("Other").alias("x"), "value"))


def sample_rows(df: DataFrame, columns: Sequence[str], k: int = rules.CHART_POINTS, seed: int = 42) -> DataFrame:
    """A repeatable random sample of k rows: the k smallest seeded hashes, a top-k without a sort
    of the table. Equal rows have equal hashes, so the whole row is hashed."""
    filled = df
    for c in columns:
        filled = filled.filter(_col(c).isNotNull())
    everything = [F.col(f"`{c}`") for c in df.columns]
    shuffled = filled.withColumn("__h", F.xxhash64(F.lit(seed), *everything))
    return shuffled.orderBy("__h", *columns).limit(k).select(*(_col(c) for c in columns))


def scatter(df: DataFrame, x: str, y: str, k: int = rules.CHART_POINTS, seed: int = 42) -> DataFrame:
    return sample_rows(df, [x, y], k, seed).select(_col(x).alias("x"), _col(y).alias("value"))


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """Exact counts of equal-width bins over all rows."""
    values = df.select(real(_col(x), df.schema[x].dataType).alias("v")).filter(F.col("v").isNotNull())
    ends = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("ends")).scalar()
    low, high = ends["low"], ends["high"]
    width = F.nullif((high - low) / bins, F.lit(0.0))
    number = F.least(F.coalesce(F.floor((F.col("v") - low) / width), F.lit(0)), F.lit(bins - 1))
    step = F.coalesce(width, F.lit(0.0))
    return (
        values.groupBy(number.alias("bin"))
        .agg(F.count("*").alias("value"))
        .select("bin", (low + F.col("bin") * step).alias("lower"), (low + (F.col("bin") + 1) * step).alias("upper"), "value")
        .orderBy("bin")
    )


def box(df: DataFrame, x: str, limit: int = REST) -> DataFrame:
    """The exact five-number summary."""
    value = real(_col(x), df.schema[x].dataType)
    found = exact_quantiles(df, {x: value}, (0.0, 0.25, 0.5, 0.75, 1.0), limit)[x]
    return df.sparkSession.createDataFrame(
        [(x, found.count, *found.values)],
        "x string, value long, low double, q1 double, median double, q3 double, high double",
    )


def box_grouped(df: DataFrame, x: str, group: str, limit: int = LIMIT) -> DataFrame:
    """The exact five-number summary of every group."""
    value = real(_col(x), df.schema[x].dataType)
    found = group_quantiles(df, _col(group).cast("string"), value, (0.0, 0.25, 0.5, 0.75, 1.0), limit)
    names = ("low", "q1", "median", "q3", "high")
    return found.select(F.lit(x).alias("x"), F.col("g").alias("grp"), F.col("count").alias("value"), *(F.col(f"q{i}").alias(n) for i, n in enumerate(names)))


def heatmap(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Pearson correlation of every pair, pairs with a missing side left out, in one pass over all
    rows. Columns without any number are dropped; a pair without rows or spread has null."""
    names = list(dict.fromkeys(columns))
    found = correlations(df, {c: real(_col(c), df.schema[c].dataType) for c in names})
    known = found.filter("a = b AND n > 0").select("a")
    usable = found.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi")
    usable = usable.select("a", "b", (F.round("r", digits) + 0.0).alias("value"))
    both = usable.select(F.col("a").alias("x"), F.col("b").alias("grp"), "value")
    mirrored = usable.filter("a <> b").select(F.col("b").alias("x"), F.col("a").alias("grp"), "value")
    return both.unionByName(mirrored)


def cross_table_line(
    dated: DataFrame, paid: DataFrame, dated_key: str, paid_key: str, date_column: str, value_column: str
) -> DataFrame:
    """Monthly sums of a value in one table over the dates of a related one.

    The value side is summed per key before the join, which collapses hot keys early."""
    sums = (
        paid.filter(_col(value_column).isNotNull() & _col(paid_key).isNotNull())
        .select(_col(paid_key).alias("k"), _y(paid, value_column))
        .groupBy("k")
        .agg(F.sum("y").alias("y"))
    )
    dates = dated.filter(_col(date_column).isNotNull()).select(
        _col(dated_key).alias("k"), month_of(_col(date_column)).alias("x")
    )
    joined = dates.join(sums, "k", "inner").groupBy("x").agg(F.sum("y").cast("double").alias("value"))
    return joined.orderBy("x")


BUILDERS = {
    "line": lambda df, s: line(df, s.x_column, s.y_column, s.group_by_column, s.aggregation),
    "bar": lambda df, s: bar(df, s.x_column, s.y_column, s.aggregation),
    "pie": lambda df, s: pie(df, s.x_column),
    "scatter": lambda df, s: scatter(df, s.x_column, s.y_column),
    "histogram": lambda df, s: histogram(df, s.x_column),
    "treemap": lambda df, s: treemap(df, s.x_column, s.y_column),
    "heatmap": lambda df, s: heatmap(df, [c.strip() for c in s.x_column.split(",") if c.strip()]),
    "box": lambda df, s: box_grouped(df, s.x_column, s.group_by_column) if s.group_by_column else box(df, s.x_column),
    "funnel": lambda df, s: funnel(df, s.x_column, s.y_column),
}


def chart_data(
    spec: ChartSpec, tables: Mapping[str, DataFrame], filters: DashboardFilters | None = None
) -> DataFrame:
    if spec.chart_type not in BUILDERS:
        raise ValueError(f"Unknown chart type: {spec.chart_type}")
    return BUILDERS[spec.chart_type](apply_filters(tables[spec.source_table], filters), spec)
