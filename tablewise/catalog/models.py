"""Catalogue: model inputs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.catalog.common import big, over_mart, plain
from tablewise.catalog.sales import CUSTOMERS
from tablewise.operators import churn, forecast, segments
from tablewise.plans import curated
from tablewise.session import stage
from tablewise.sources.mart import Mart


def _summary(spark, folder):
    mart = Mart(spark, folder)
    return curated.customer_summary(mart.customers, mart.orders, mart.items)


def churn_features(spark, folder):
    return churn.churn_features(_summary(spark, folder))


def rfm_features(spark, folder):
    return segments.rfm_features(_summary(spark, folder))


def churn_scores(spark, folder):
    features = stage(churn_features(spark, folder), "churn")
    model = churn.train_churn(features)
    scored = churn.score_churn(features, model)
    return scored.select("customer_unique_id", "churn_label", "churn_probability", "churn_prediction")


def rfm_segments(spark, folder):
    return segments.segment_customers(stage(rfm_features(spark, folder), "rfm"))


def segment_labels(spark, folder):
    """The labelling rule over the mean behaviour of the customers of four regions."""
    mart = Mart(spark, folder)
    summary = curated.customer_summary(mart.customers, mart.orders, mart.items)
    cluster = F.pmod(F.regexp_extract("customer_state", r"(\d+)", 1).cast("int"), F.lit(4))
    means = summary.groupBy(cluster.alias("cluster")).agg(
        *(F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in segments.rules.RFM_COLUMNS)
    )
    return plain(segments.label_clusters(means))


def revenue_forecast(spark, folder):
    mart = Mart(spark, folder)
    return plain(forecast.forecast_revenue(curated.monthly_revenue(mart.orders, mart.items)))


def category_forecast(spark, folder):
    """One forecast per product category, fitted side by side."""
    mart = Mart(spark, folder)
    sold = mart.items.join(mart.orders, "order_id", "inner").join(mart.products, "product_id", "inner")
    monthly = sold.groupBy(
        F.date_trunc("month", "order_purchase_timestamp").alias("month"), "product_category_name"
    ).agg(F.sum("price").cast("double").alias("total_revenue"))
    series = forecast.monthly_series(monthly, series=F.col("product_category_name"))
    return plain(forecast.forecast_series(series))


_MEANS = """
means AS (SELECT CAST(regexp_extract(customer_state, '(\\d+)', 1) AS INT) % 4 AS cluster,
  ROUND(AVG(CAST(days_since_last_order AS DOUBLE)), 4) AS recency, ROUND(AVG(CAST(total_orders AS DOUBLE)), 4) AS orders,
  ROUND(AVG(total_spend), 4) AS spend FROM v_customers GROUP BY 1),
scored AS (SELECT *, (rank() OVER (ORDER BY spend) + rank() OVER (ORDER BY orders) - rank() OVER (ORDER BY recency)) AS score FROM means),
champion AS (SELECT cluster FROM scored ORDER BY score DESC, cluster LIMIT 1),
loyal AS (SELECT cluster FROM scored WHERE cluster NOT IN (FROM champion) ORDER BY orders DESC, cluster LIMIT 1),
rest AS (SELECT *, recency + rank() OVER (ORDER BY spend) AS worst FROM scored
  WHERE cluster NOT IN (FROM champion) AND cluster NOT IN (FROM loyal)),
lost AS (SELECT cluster FROM rest ORDER BY worst DESC, cluster LIMIT 1)"""

QUERIES = {
    "churn_features": (
        churn_features,
        over_mart(
            """
SELECT customer_unique_id, CAST(total_orders AS DOUBLE) AS total_orders, total_spend, avg_order_value,
  CAST(days_since_last_order AS DOUBLE) AS days_since_last_order, CAST(customer_tenure_days AS DOUBLE) AS customer_tenure_days,
  CAST(NULL AS DOUBLE) AS avg_review_score,
  CAST(CASE WHEN days_since_last_order > 180 THEN 1 ELSE 0 END AS DOUBLE) AS churn_label FROM v_customers""",
            CUSTOMERS,
        ),
    ),
    "rfm_features": (
        rfm_features,
        over_mart(
            "SELECT customer_unique_id, CAST(days_since_last_order AS DOUBLE) AS days_since_last_order,"
            " CAST(total_orders AS DOUBLE) AS total_orders, total_spend FROM v_customers",
            CUSTOMERS,
        ),
    ),
    "segment_labels": (
        segment_labels,
        over_mart(
            f"""
SELECT {big("cluster")} AS cluster, CASE WHEN cluster IN (FROM champion) THEN 'Champions' WHEN cluster IN (FROM loyal) THEN 'Loyal'
  WHEN cluster IN (FROM lost) THEN 'Lost' ELSE 'At Risk' END AS segment FROM means""",
            CUSTOMERS, _MEANS,
        ),
    ),
    "churn_scores": (churn_scores, None),
    "rfm_segments": (rfm_segments, None),
    "revenue_forecast": (revenue_forecast, None),
    "category_forecast": (category_forecast, None),
}
