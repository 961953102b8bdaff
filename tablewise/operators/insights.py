"""Sentences about chart data and metrics, built from their (small) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import grouped_number, one_place, ratio
from tablewise.operators import charts
from tablewise.operators.charts import ChartSpec

SEGMENT_CHARTS = ("bar", "pie", "treemap", "funnel")
# fixed values: chart types a shared dashboard may show
PUBLIC_CHARTS = ("line", "bar", "pie", "treemap", "heatmap", "funnel")


def chart_sample(spec: ChartSpec, df: DataFrame) -> DataFrame | None:
    """The aggregate an insight is written from, over all points, groups or values; None for charts
    without a sentence."""
    kind, agg = spec.chart_type, spec.aggregation
    if spec.y_column and agg in ("sum", "avg", "count") and kind != "heatmap":
        if kind == "line":
            return charts.line(df, spec.x_column, spec.y_column, aggregation=agg)
        return charts.top_groups(df, spec.x_column, spec.y_column, agg)
    if kind in ("pie", "funnel"):
        return charts.top_groups(df, spec.x_column)
    if kind in ("histogram", "box"):
        value = F.col(f"`{spec.x_column}`")
        return df.filter(value.isNotNull()).select(value.alias("value"))
    return None


def chart_rows(data: DataFrame, k: int | None = None) -> DataFrame:
    """Chart data in the order of its columns, or the first k rows of it."""
    ordered = data.orderBy(*data.columns)
    return ordered if k is None else ordered.limit(k)


def fallback_insight(data: DataFrame, title: str, chart_type: str) -> DataFrame:
    """One sentence pair from the rows of one chart: the leading segment and its share, or the
    range of the values."""
    has_label = "x" in data.columns
    label = F.col("x").cast("string") if has_label else F.lit("the leading item")
    value = F.col("value").cast("double")
    order = F.struct(-value, *([F.col("x")] if has_label else []))
    facts = data.agg(
        F.count("*").alias("n"),
        F.count(value).alias("filled"),
        F.min_by(label, order).alias("top"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.sum(value).alias("total"),
    )
    high, low = grouped_number(F.col("high")), grouped_number(F.col("low"))
    share = F.coalesce(ratio(F.col("high"), F.col("total")) * 100, F.lit(0.0))
    segments = F.concat(
        F.col("top"), F.lit(" leads with "), high, F.lit(", "),
        one_place(share), F.lit("% of the sum over "), F.col("n"), F.lit(" groups."),
    )
    spread = F.concat(
        F.lit("Values lie between "), low, F.lit(" and "), high, F.lit(" over "), F.col("n"), F.lit(" points."),
    )
    empty = F.concat(
        F.lit(f"{title}: "), F.col("n"), F.lit(" points without a value."),
    )
    text = segments if chart_type in SEGMENT_CHARTS else spread
    return facts.select(
        F.lit(title).alias("chart_title"), F.lit(chart_type).alias("chart_type"),
        F.when(F.col("filled") == 0, empty).otherwise(text).alias("insight_text"),
    )


def executive_summary(metrics: DataFrame, insights: DataFrame) -> DataFrame:
    """The first metric (by category, then name) followed by the newest insight."""
    first = metrics.agg(
        F.min_by(F.struct("kpi_name", "kpi_value", "kpi_unit"), F.struct("kpi_category", "kpi_name")).alias("k")
    )
    newest = insights.agg(F.max_by("insight_text", "generated_at").alias("t")).scalar()
    headline = F.concat(
        F.col("k.kpi_name"), F.lit(" is "), grouped_number(F.col("k.kpi_value")), F.lit(" "),
        F.coalesce("k.kpi_unit", F.lit("")), F.lit("."),
    )
    ready = F.lit("There are no metrics yet.")
    advice = F.lit("There are no chart notes yet.")
    return first.select(
        F.concat_ws(" ", F.coalesce(headline, ready), F.coalesce(newest, advice)).alias("summary")
    )


def public_subset(
    metrics: DataFrame, insights: DataFrame, chart_configs: DataFrame, session_id: str,
    newest: int | None = None, charts: int | None = None,
) -> dict[str, DataFrame]:
    """What a shared dashboard shows: the metrics, the insights from the newest on and the charts of the
    allowed types, each cut only where a number is given."""
    def first(df: DataFrame, k: int | None) -> DataFrame:
        return df if k is None else df.limit(k)

    mine: Column = F.col("session_id") == session_id
    return {
        "kpis": metrics.filter(mine).orderBy("kpi_category", "kpi_name"),
        "insights": first(
            insights.filter(mine & (F.col("insight_type") == "chart_insight")).orderBy(F.desc("generated_at")), newest
        ),
        "charts": first(
            chart_configs.filter(mine & F.col("chart_type").isin(*PUBLIC_CHARTS)).orderBy("chart_order"), charts
        ),
    }

