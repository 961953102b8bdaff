"""The tables of a session report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import file_size_text, grouped_number
from tablewise.operators import kpi
from tablewise.operators.filters import DashboardFilters, apply_filters
from tablewise.operators.charts import ChartSpec, chart_data
from tablewise.sources.metadata import MetadataStore



def scope_text(sessions: DataFrame, filters: DashboardFilters | None) -> DataFrame:
    parts = [
        F.concat(F.lit("Status: "), F.col("status")),
        F.concat(F.lit("Rows: "), F.format_number("total_rows", 0)),
    ]
    if filters is None or not filters.active:
        parts.append(F.lit("no filter"))
    else:
        if filters.date_from or filters.date_to:
            parts.append(F.lit(f"from {filters.date_from or 'the first day'} until {filters.date_to or 'the last'}"))
        if filters.category_value:
            parts.append(F.lit(f"only {filters.category_value}"))
    return sessions.select("session_id", F.concat(F.concat_ws(" | ", *parts), F.lit(".")).alias("scope"))


def kpi_table(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("rank").select(
        "rank", "kpi_name", grouped_number(F.col("kpi_value")).alias("value"), "kpi_unit", "kpi_category"
    )


def chart_table(data: DataFrame, k: int | None = None) -> DataFrame:
    """A chart as text in the order of its labels, or its first k rows."""
    shown = [grouped_number(F.col("value")).alias("value")]
    if "x" in data.columns:
        shown.insert(0, F.col("x").cast("string").alias("x"))
    ordered = data.orderBy(*data.columns)
    return (ordered if k is None else ordered.limit(k)).select(*shown)


def report_tables(
    store: MetadataStore,
    session_id: str,
    tables: dict[str, DataFrame],
    types: dict[str, dict[str, str]],
    charts: list[ChartSpec],
    filters: DashboardFilters | None = None,
) -> dict[str, DataFrame]:
    """Sections by name: scope, metrics, files, quality, and one per chart."""
    if filters is not None:
        filters.validate()
    sections = {
        "scope": scope_text(store.status(session_id), filters),
        "kpis": kpi_table(kpi.calculate_metrics(tables, types, filters)),
        "files": store.read("uploaded_files", session_id).orderBy("uploaded_at", "original_filename").select(
            "original_filename", "row_count", "column_count", file_size_text(F.col("file_size_bytes")).alias("size")
        ),
        "quality": store.read("quality_reports", session_id).orderBy("table_name").select(
            "table_name", "quality_score", "total_rows", "duplicate_rows", "columns_with_nulls", "outlier_columns"
        ),
    }
    for spec in charts:
        if spec.source_table in tables and spec.chart_type not in ("histogram", "box"):
            source = {spec.source_table: apply_filters(tables[spec.source_table], filters)}
            sections[f"chart {spec.chart_order}: {spec.chart_title}"] = chart_table(chart_data(spec, source))
    return sections
