"""A whole session: read, profile, score, clean, write, relate, measure, chart and explain."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewise.functions import names
from tablewise.operators import charts, clean, compare, insights, joins, kpi, quality, relate
from tablewise.operators.charts import ChartSpec
from tablewise.operators.profile import ColumnProfile, profile_table, profiles_to_frame, types_of
from tablewise.plans import chart_choice, generated
from tablewise.session import configure, per_table, work_folder
from tablewise.sources.files import read_tables
from tablewise.sources.metadata import MetadataStore, now


@dataclass
class SessionRun:
    session_id: str
    status: str = "pending"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    profiles: dict[str, Sequence[ColumnProfile]] = field(default_factory=dict)
    cleaned: dict[str, clean.CleanedTable] = field(default_factory=dict)
    relationships: list[relate.Relationship] = field(default_factory=list)
    views: dict[str, DataFrame] = field(default_factory=dict)
    metrics: DataFrame | None = None
    charts: list[ChartSpec] = field(default_factory=list)
    row_counts: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def types(self) -> dict[str, dict[str, str]]:
        return {t: types_of(p) for t, p in self.profiles.items()}


def write_table(df: DataFrame, path: str) -> int:
    """Replace a table; the row count comes from the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def load_tables(run: SessionRun, root: str) -> None:
    """Write every cleaned table; a failed one is reported and the others go on."""
    for name, table in run.cleaned.items():
        path = f"{root.rstrip('/')}/{name}"
        try:
            run.row_counts[name] = write_table(table.df, path)
        except Exception as problem:
            run.errors.append(f"{name}: {problem}")
            continue
        loaded = table.df.sparkSession.read.parquet(path)
        loaded.createOrReplaceTempView(name)
        run.tables[name] = loaded
    if not run.tables:
        run.status = "error"
    else:
        run.status = "partial" if run.errors else "loading"


def run_analytics(run: SessionRun, store: MetadataStore) -> tuple[int, int]:
    """Metrics and charts of the loaded tables; returns how many of each."""
    types = run.types
    run.metrics = kpi.calculate_metrics(run.tables, types)
    run.charts = chart_choice.choose_charts(
        {t: run.profiles[t] for t in run.tables}, run.relationships, run.tables
    )
    spark = store.spark
    store.replace("kpi_results", run.metrics, run.session_id)
    store.replace("chart_configs", chart_choice.charts_to_frame(spark, run.session_id, run.charts), run.session_id)
    return store.read("kpi_results", run.session_id).count(), len(run.charts)


def write_insights(run: SessionRun, store: MetadataStore) -> None:
    sources = run.tables | run.views
    frames = []
    for spec in run.charts:
        source = sources.get(spec.source_table)
        sample = insights.chart_sample(spec, source) if source is not None else None
        if sample is not None:
            text = insights.fallback_insight(sample, spec.chart_title, spec.chart_type)
            frames.append(
                text.select(
                    F.lit("chart_insight").alias("insight_type"),
                    F.lit(spec.chart_order).alias("chart_order"), "insight_text",
                )
            )
    if frames:
        store.replace("insights", reduce(lambda a, b: a.unionByName(b), frames), run.session_id)


def evaluate_alerts(run: SessionRun, store: MetadataStore, filters=None) -> DataFrame | None:
    """Alerts for the last 30 days (or the given period), each notified once."""
    alerts = compare.evaluate_alerts(run.tables, run.types, filters)
    if alerts is not None:
        store.notify_once(run.session_id, alerts)
    return alerts


def alert_history(store: MetadataStore, session_id: str, k: int | None = None) -> DataFrame:
    recent = store.notifications(session_id, k)
    return recent.withColumn("severity", compare.severity_of(F.col("event_type")))


def run_session(
    spark: SparkSession,
    store: MetadataStore,
    paths: Sequence[str] = (),
    tables: Mapping[str, DataFrame] | None = None,
    session_id: str | None = None,
    table_root: str | None = None,
    orient: str = "contained",
) -> SessionRun:
    """Run all stages. Loading problems end in ``partial`` or ``error``; problems with views,
    metrics, charts or alerts are recorded and do not stop the run."""
    configure(spark)
    run = SessionRun(session_id or str(uuid.uuid4()))
    root = table_root or work_folder(spark, f"tables-{names.session_prefix(run.session_id)}")

    def status(name: str, **facts) -> None:
        run.status = name
        store.set_status(run.session_id, name, **facts)

    try:
        status("profiling")
        raw, facts = dict(tables or {}), {}
        if paths:
            read, facts, run.warnings = read_tables(spark, paths, run.session_id)
            raw |= read
        run.profiles = per_table(lambda t, df: profile_table(df, t), raw)
        scored = per_table(lambda t, df: quality.quality_report(df, t, run.profiles[t]), raw)
        reports = reduce(lambda a, b: a.unionByName(b), scored.values())
        status("extracting")
        status("cleaning")
        run.cleaned = clean.clean_tables(raw, run.profiles)
        status("loading")
        load_tables(run, root)
        if run.status == "error":
            raise RuntimeError("; ".join(run.errors))
        loaded = run.status
        store.append("schema_profiles", _with_session(profiles_to_frame(spark, run.profiles), run.session_id))
        store.append("quality_reports", quality.storage_row(reports, run.session_id))
        files = [
            (
                run.session_id, facts.get(t, {}).get("file", t), t, facts.get(t, {}).get("size"),
                run.row_counts[t], len(run.profiles[t]), facts.get(t, {}).get("encoding"), now(),
            )
            for t in run.tables
        ]
        columns = (
            "session_id string, original_filename string, table_name string, file_size_bytes long,"
            " row_count long, column_count long, encoding string, uploaded_at timestamp"
        )
        store.append("uploaded_files", spark.createDataFrame(files, columns))
        store.notify(run.session_id, quality.outlier_notice(reports))
        profiles = {t: run.profiles[t] for t in run.tables}
        run.relationships = relate.detect_relationships(run.tables, profiles, orient)
        store.append(
            "detected_relationships",
            _with_session(relate.relationships_to_frame(spark, run.relationships), run.session_id),
        )
    except Exception as problem:
        run.errors.append(str(problem))
        status("error", error_message=str(problem))
        raise
    for name, step in (
        ("joining", lambda: _join(run)),
        ("analyzing", lambda: (run_analytics(run, store), write_insights(run, store), evaluate_alerts(run, store))),
    ):
        status(name)
        try:
            step()
        except Exception as problem:  # views and analytics are optional
            run.warnings.append(f"{name}: {problem}")
    status(
        "partial" if loaded == "partial" else "done",
        total_files=len(run.tables), total_rows=sum(run.row_counts.values()), completed_at=now(),
        error_message="; ".join(run.errors) or None,
    )
    return run


def _with_session(df: DataFrame, session_id: str) -> DataFrame:
    return df.withColumn("session_id", F.lit(session_id))


def _join(run: SessionRun) -> None:
    joined = joins.create_join_views(run.session_id, run.tables, run.relationships)
    run.errors += joined.errors
    run.views |= joined.views
    run.views |= generated.generated_views(run.session_id, run.tables, run.types)


def chart_frames(run: SessionRun, filters=None) -> dict[int, DataFrame]:
    sources = run.tables | run.views
    return {
        s.chart_order: charts.chart_data(s, sources, filters) for s in run.charts if s.source_table in sources
    }
