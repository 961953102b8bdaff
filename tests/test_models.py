import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import churn, forecast, segments
from tablewise.operators.train import train_model


@pytest.fixture(scope="module")
def customers(spark):
    rows = [
        (f"c{i}", i % 9 + 1, float(i % 50), 10.0 + i % 3, 20 + 170 * (i % 2) + i % 7, i % 100, None if i % 5 else 4.0, i % 2)
        for i in range(200)
    ]
    return spark.createDataFrame(
        rows,
        "customer_unique_id string, total_orders int, total_spend double, avg_order_value double,"
        " days_since_last_order int, customer_tenure_days int, avg_review_score double, churn_label int",
    )


def test_churn(customers, tmp_path):
    model = churn.train_churn(customers, iterations=5, depth=3)
    assert "customer_unique_id" not in model.features and "churn_label" not in model.features
    assert model.holdout_auc > 0.9 and model.positive_weight == pytest.approx(1.0)
    scored = churn.score_churn(customers.drop("avg_review_score"), model)
    wrong = scored.filter((F.col("churn_probability") >= 0.5) != (F.col("churn_prediction") == 1)).count()
    assert scored.count() == 200 and wrong == 0
    model.save(str(tmp_path / "model"))
    again = churn.score_churn(customers, churn.load_churn(str(tmp_path / "model")))
    first = churn.score_churn(customers, model)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    holes = customers.withColumn("total_spend", F.lit(None).cast("double"))
    assert churn.score_churn(holes, model).filter("total_spend IS NOT NULL").count() == 0  # inputs stay
    with pytest.raises(ValueError, match="churn needs the columns total_spend"):
        churn.score_churn(customers.drop("total_spend"), model)
    with pytest.raises(ValueError, match="both of its classes"):
        churn.train_churn(customers.filter("churn_label = 1"))


def test_stratified_split_is_exact_and_repeatable(customers):
    train, rest = churn.stratified_split(customers, "churn_label", 0.8, "customer_unique_id")
    counts = {r["churn_label"]: r["count"] for r in train.groupBy("churn_label").count().collect()}
    assert counts == {0: 80, 1: 80} and rest.count() == 40
    again, _ = churn.stratified_split(customers.repartition(7), "churn_label", 0.8, "customer_unique_id")
    assert again.exceptAll(train).count() == 0


def test_segments(spark, tmp_path):
    groups = [(2, 20, 1000), (5, 15, 700), (20, 5, 150), (80, 1, 20)] * 10
    df = spark.createDataFrame(groups, "days_since_last_order int, total_orders int, total_spend int")
    out = segments.segment_customers(df, starts=3)
    names = {(r[0], r["segment"]) for r in out.select("days_since_last_order", "segment").distinct().collect()}
    assert names == {(2, "Champions"), (5, "Loyal"), (20, "At Risk"), (80, "Lost")}
    model = segments.train_segments(df, starts=3)
    model.save(str(tmp_path / "segments"))
    again = segments.load_segments(str(tmp_path / "segments")).score(df.limit(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, model.score(df.limit(7)).collect()))
    with pytest.raises(ValueError, match="segments need the columns"):
        segments.segment_customers(df.drop("total_spend"))
    with pytest.raises(ValueError, match="too few customers"):
        segments.segment_customers(df.limit(3))
    with pytest.raises(ValueError, match="four clusters, no more"):
        segments.segment_customers(df, clusters=3)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int")
    got = [r[0] for r in df.orderBy("v").select(segments.average_rank("v")).collect()]
    assert sorted(got) == pd.Series([1, 2, 2, 5]).rank().tolist()


def monthly(spark, n, value=lambda i: 100.0 + 10 * i):
    rows = [(dt.datetime(2020 + i // 12, i % 12 + 1, 1), value(i)) for i in range(n)]
    return spark.createDataFrame(rows, "month timestamp, total_revenue double")


def test_forecast_follows_a_trend(spark):
    rows = forecast.forecast_revenue(monthly(spark, 36), horizon=3).orderBy("ds").collect()
    assert [r["ds"] for r in rows] == [dt.datetime(2023, m, 1) for m in (1, 2, 3)]
    assert all(abs(r["yhat"] - (460 + 10 * i)) < 25 for i, r in enumerate(rows))
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in rows)
    assert rows[0]["mae"] < 30 and rows[0]["mape"] < 8


def test_forecast_edges(spark):
    short = forecast.forecast_revenue(monthly(spark, 7)).first()
    assert short["mae"] is None and short["months"] == 7
    with pytest.raises(ValueError, match="six months"):
        forecast.forecast_revenue(monthly(spark, 5))
    with pytest.raises(ValueError, match="one month ahead"):
        forecast.forecast_revenue(monthly(spark, 12), horizon=0)
    with pytest.raises(ValueError, match="a forecast needs the columns"):
        forecast.forecast_revenue(monthly(spark, 12).drop("total_revenue"))
    zeros = forecast.forecast_revenue(monthly(spark, 12, lambda i: 0.0)).first()
    assert zeros["mape"] is None and zeros["yhat"] == pytest.approx(0.0)


def test_many_series(spark):
    one = monthly(spark, 24).withColumn("name", F.lit("a"))
    both = one.unionByName(monthly(spark, 4).withColumn("name", F.lit("b")))
    out = forecast.forecast_series(forecast.monthly_series(both, series=F.col("name")), 2)
    assert [r["series"] for r in out.collect()] == ["a", "a"]


def test_train_by_name(spark, tmp_path):
    train_model("forecast", monthly(spark, 12), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "forecast_results")).count() == 3
    with pytest.raises(ValueError, match="Unknown model type"):
        train_model("magic", monthly(spark, 12))
