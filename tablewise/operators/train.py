"""Model training by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewise.operators import churn, forecast, segments


def _churn(df: DataFrame, path: str | None, **options):
    model = churn.train_churn(df, **options)
    if path:
        model.save(f"{path}/churn_model")
    return model


def _forecast(df: DataFrame, path: str | None, **options):
    result = forecast.forecast_revenue(df, **options)
    if path:
        result.write.mode("overwrite").parquet(f"{path}/forecast_results")
    return result


def _segments(df: DataFrame, path: str | None, **options):
    model = segments.train_segments(df, **options)
    if path:
        model.save(f"{path}/segments")
    return model.score(df)


TRAINERS = {"churn": _churn, "forecast": _forecast, "segmentation": _segments}


def train_model(kind: str, df: DataFrame, path: str | None = None, **options):
    if kind not in TRAINERS:
        raise ValueError(f"Unknown model type: {kind}")
    return TRAINERS[kind](df, path, **options)
