"""Curated sales views and questions over an order mart.

Items are summed per order before the join wherever a view works at order grain: the partial
sums collapse a hot order on the map side, and the later distinct counts expand orders rather
than lines. Every other distinct count is left to Spark's two-step distinct aggregation, which
shuffles (group, key) pairs, so a hot group never lands in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import rules
from tablewise.functions.columns import moment_literal, month_of, ratio, rounded, whole_days
from tablewise.sources.mart import STATUS_NAMES

DELIVERED = STATUS_NAMES["F"]


def _order_sums(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.sum("price").alias("order_price"),
        F.count("price").alias("priced_items"),
        F.sum("freight_value").alias("order_freight"),
    )


def _mean_price() -> Column:
    return rounded(ratio(F.sum("order_price"), F.sum("priced_items")), 2)


def share_of_total(df: DataFrame, value: str) -> Column:
    """100 · value / Σ value; ``df`` holds one row per group, and only these are summed."""
    total = F.sum(value).over(Window.partitionBy(F.lit(1)))
    return rounded(ratio(F.col(value).cast("double") * 100, total), 2)


def monthly_revenue(orders: DataFrame, items: DataFrame) -> DataFrame:
    delivered = orders.filter(
        F.col("order_purchase_timestamp").isNotNull() & (F.col("order_status") == DELIVERED)
    ).select("order_id", "customer_id", month_of(F.col("order_purchase_timestamp")).alias("month"))
    return (
        delivered.join(_order_sums(items), "order_id", "inner")
        .groupBy("month")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.count_distinct("customer_id").alias("unique_customers"),
            rounded(F.sum("order_price"), 2).alias("total_revenue"),
            _mean_price().alias("avg_order_value"),
            rounded(ratio(F.sum("order_price"), F.count_distinct("order_id")), 2).alias("true_aov"),
            rounded(F.sum("order_freight"), 2).alias("total_freight"),
        )
        .orderBy("month")
    )


def revenue_by_category(items: DataFrame, products: DataFrame) -> DataFrame:
    per_category = (
        items.join(products, "product_id", "inner")
        .groupBy(F.col("product_category_name").alias("category"))
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.count_distinct("product_id").alias("unique_products"),
            F.sum("price").alias("revenue"),
            F.count("price").alias("priced_items"),
        )
    )
    return per_category.select(
        "category",
        "total_orders",
        "unique_products",
        rounded(F.col("revenue"), 2).alias("total_revenue"),
        rounded(ratio(F.col("revenue"), F.col("priced_items")), 2).alias("avg_price"),
        share_of_total(per_category, "revenue").alias("revenue_share_pct"),
    ).orderBy(F.desc("total_revenue"), "category")


def latest_purchase(orders: DataFrame) -> dt.datetime | None:
    """The default reporting moment: the last purchase in the data. It is looked up first, one
    value, so that the date conditions made from it are literals the scan can use."""
    return orders.agg(F.max(F.col("order_purchase_timestamp").cast("timestamp_ntz"))).first()[0]


def _as_of(orders: DataFrame, as_of: dt.datetime | None) -> dt.datetime:
    return as_of or latest_purchase(orders) or dt.datetime(1970, 1, 1)


def _month_start(moment: dt.datetime, months_later: int = 0) -> dt.datetime:
    count = moment.year * 12 + moment.month - 1 + months_later
    return dt.datetime(count // 12, count % 12 + 1, 1)


def _bought_between(first: dt.datetime, end: dt.datetime | None = None) -> Column:
    bought = F.col("order_purchase_timestamp")
    since = bought >= moment_literal(first)
    return since if end is None else since & (bought < moment_literal(end))


def customer_summary(
    customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: dt.datetime | None = None
) -> DataFrame:
    """One row per customer. Rows are not sorted: an ordering of all customers would cost a
    range shuffle that no reader of the view needs."""
    as_of = _as_of(orders, as_of)
    bought = (
        orders.filter(F.col("order_status") == DELIVERED)
        .select("order_id", "customer_id", "order_purchase_timestamp")
        .join(_order_sums(items), "order_id", "inner")
    )
    stats = (
        customers.join(bought, "customer_id", "inner")
        .groupBy("customer_unique_id", "customer_city", "customer_state")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            rounded(F.sum("order_price"), 2).alias("total_spend"),
            _mean_price().alias("avg_order_value"),
            rounded(ratio(F.sum("order_price"), F.count_distinct("order_id")), 2).alias("true_aov"),
            F.min("order_purchase_timestamp").alias("first_order_date"),
            F.max("order_purchase_timestamp").alias("last_order_date"),
        )
    )
    quiet = whole_days(moment_literal(as_of), F.col("last_order_date").cast("timestamp_ntz"))
    return (
        stats.withColumn(
            "customer_tenure_days", whole_days(F.col("last_order_date"), F.col("first_order_date"))
        )
        .withColumn("days_since_last_order", quiet)
        .withColumn(
            "churn_label", (F.col("days_since_last_order") > rules.CHURN_AFTER_DAYS).cast("int")
        )
    )


def order_status_breakdown(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("order_status").agg(F.count("*").alias("order_count"))
    return counts.select(
        "order_status", "order_count", share_of_total(counts, "order_count").alias("percentage")
    ).orderBy(F.desc("order_count"), "order_status")


def top_products(items: DataFrame, products: DataFrame, k: int = 20) -> DataFrame:
    """Revenue is summed per product before the join, so a hot product collapses on the map
    side; only the k winners are returned."""
    per_product = items.groupBy("product_id").agg(
        F.count_distinct("order_id").alias("times_ordered"),
        F.sum("price").alias("revenue"),
        F.count("price").alias("priced_items"),
    )
    # equal product rows multiply the joined lines, so their number scales the sums
    listed = products.groupBy("product_id", "product_category_name").agg(F.count("*").alias("copies"))
    return (
        per_product.join(listed, "product_id", "inner")
        .select(
            "product_id",
            F.col("product_category_name").alias("category"),
            "times_ordered",
            rounded(F.col("revenue") * F.col("copies"), 2).alias("total_revenue"),
            rounded(ratio(F.col("revenue"), F.col("priced_items")), 2).alias("avg_price"),
        )
        .orderBy(F.desc("total_revenue"), "product_id", "category")
        .limit(k)
    )


def revenue_by_state(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    bought = (
        orders.filter(F.col("order_status") == DELIVERED)
        .select("order_id", "customer_id")
        .join(_order_sums(items), "order_id", "inner")
    )
    return (
        customers.select("customer_id", "customer_unique_id", "customer_state")
        .join(bought, "customer_id", "inner")
        .groupBy(F.col("customer_state").alias("state"))
        .agg(
            F.count_distinct("customer_unique_id").alias("unique_customers"),
            F.count_distinct("order_id").alias("total_orders"),
            rounded(F.sum("order_price"), 2).alias("total_revenue"),
            _mean_price().alias("avg_order_value"),
            rounded(ratio(F.sum("order_price"), F.count_distinct("order_id")), 2).alias("true_aov"),
        )
        .orderBy(F.desc("total_revenue"), "state")
    )


def delivery_performance(deliveries: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    arrived = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")

    def mean_days(later: Column, earlier: Column) -> Column:
        days = whole_days(later, earlier)
        return rounded(ratio(F.sum(days), F.count(days)), 1)

    return (
        deliveries.filter(bought.isNotNull())
        .groupBy(month_of(bought).alias("month"))
        .agg(
            F.count("*").alias("total_orders"),
            F.count(arrived).alias("delivered_orders"),
            mean_days(arrived, bought).alias("avg_delivery_days"),
            mean_days(promised, bought).alias("avg_estimated_days"),
            mean_days(arrived, promised).alias("avg_delay_days"),
        )
        .orderBy("month")
    )


def delivery_status(deliveries: DataFrame, months: int = 12) -> DataFrame:
    delay = F.col("avg_delay_days")
    verdict = (
        F.when(delay > 3, F.lit("Significant Delays"))
        .when(delay > 0, F.lit("Minor Delays"))
        .when(delay <= 0, F.lit("On Time or Early"))
    )
    return (
        delivery_performance(deliveries)
        .select("month", "avg_delivery_days", "avg_estimated_days", "avg_delay_days", verdict.alias("delivery_status"))
        .orderBy(F.desc("month"))
        .limit(months)
    )


def month_vs_last_month(orders: DataFrame, items: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Both months in one pass: only their two months reach the join."""
    as_of = _as_of(orders, as_of)
    this_month = _month_start(as_of)
    recent = orders.filter(_bought_between(_month_start(as_of, -1), _month_start(as_of, 1))).select(
        "order_id", _bought_between(this_month).alias("is_current")
    )
    sums = recent.join(items.select("order_id", "price"), "order_id", "inner").agg(
        F.sum(F.when(F.col("is_current"), F.col("price"))).alias("now"),
        F.sum(F.when(~F.col("is_current"), F.col("price"))).alias("before"),
    )
    return sums.select(
        moment_literal(this_month).alias("current_month"),
        rounded(F.coalesce("now", F.lit(0)), 2).alias("revenue_this_month"),
        rounded(F.coalesce("before", F.lit(0)), 2).alias("revenue_last_month"),
    )


def top_categories_last_month(
    orders: DataFrame, items: DataFrame, products: DataFrame, as_of: dt.datetime | None = None, k: int = 5
) -> DataFrame:
    as_of = _as_of(orders, as_of)
    last_month = _bought_between(_month_start(as_of, -1), _month_start(as_of))
    chosen = orders.filter((F.col("order_status") == DELIVERED) & last_month).select("order_id")
    return (
        chosen.join(items.select("order_id", "product_id", "price"), "order_id", "inner")
        .join(products, "product_id", "inner")
        .groupBy(F.col("product_category_name").alias("category"))
        .agg(F.count_distinct("order_id").alias("orders"), rounded(F.sum("price"), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
        .limit(k)
    )


def recent_demand(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    as_of: dt.datetime | None = None,
    days: int = 30,
    k: int = 10,
) -> DataFrame:
    since = _as_of(orders, as_of) - dt.timedelta(days=days)
    chosen = orders.filter(_bought_between(since)).select("order_id")
    return (
        chosen.join(items.select("order_id", "product_id", "price"), "order_id", "inner")
        .join(products, "product_id", "inner")
        .groupBy(F.col("product_category_name").alias("category"))
        .agg(F.count("order_id").alias("recent_orders"), rounded(F.sum("price"), 2).alias("recent_revenue"))
        .orderBy(F.desc("recent_orders"), "category")
        .limit(k)
    )


def churn_risk(summary: DataFrame, k: int = 20) -> DataFrame:
    quiet = F.col("days_since_last_order")
    risk = (
        F.when(quiet > rules.CHURN_AFTER_DAYS, F.lit("High Risk"))
        .when(quiet > rules.CHURN_WARN_DAYS, F.lit("Medium Risk"))
        .otherwise(F.lit("Active"))
    )
    return (
        summary.filter(quiet > rules.CHURN_WARN_DAYS)
        .select(
            "customer_unique_id", "customer_state", "total_orders", "total_spend",
            "days_since_last_order", risk.alias("churn_risk"),
        )
        .orderBy(F.desc("days_since_last_order"), "customer_unique_id")
        .limit(k)
    )


def month_over_month(monthly: DataFrame) -> DataFrame:
    """The window runs over one row per calendar month, never over source rows."""
    before = F.lag("total_revenue").over(Window.orderBy("month"))
    rows = monthly.select("month", "total_revenue", before.alias("prev_month_revenue"))
    moved = (F.col("total_revenue") - F.col("prev_month_revenue")).cast("double")
    change = ratio(moved * 100, F.col("prev_month_revenue"))
    return rows.withColumn("mom_growth_pct", rounded(change, 2))
