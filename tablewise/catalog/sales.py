"""Catalogue: curated sales views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.catalog.common import big, div, over_mart, plain, rnd
from tablewise.plans import curated
from tablewise.sources.mart import Mart

MONTHLY = f"""
v_monthly AS (
  SELECT date_trunc('month', o.order_purchase_timestamp) AS month,
         {big("COUNT(DISTINCT o.order_id)")} AS total_orders,
         {big("COUNT(DISTINCT o.customer_id)")} AS unique_customers,
         ROUND(SUM(i.price), 2) AS revenue,
         {rnd("SUM(i.price)")} AS total_revenue,
         {rnd(div("SUM(i.price)", "COUNT(i.price)"))} AS avg_order_value,
         {rnd(div("SUM(i.price)", "COUNT(DISTINCT o.order_id)"))} AS true_aov,
         {rnd("SUM(i.freight_value)")} AS total_freight
  FROM m_orders o JOIN m_items i ON o.order_id = i.order_id
  WHERE o.order_purchase_timestamp IS NOT NULL AND o.order_status = 'Delivered'
  GROUP BY 1)
"""

CUSTOMERS = f"""
v_customers AS (
  SELECT c.customer_unique_id, c.customer_city, c.customer_state,
         {big("COUNT(DISTINCT o.order_id)")} AS total_orders,
         {rnd("SUM(i.price)")} AS total_spend,
         {rnd(div("SUM(i.price)", "COUNT(i.price)"))} AS avg_order_value,
         {rnd(div("SUM(i.price)", "COUNT(DISTINCT o.order_id)"))} AS true_aov,
         MIN(o.order_purchase_timestamp) AS first_order_date,
         MAX(o.order_purchase_timestamp) AS last_order_date,
         {big("EXTRACT(DAY FROM MAX(o.order_purchase_timestamp) - MIN(o.order_purchase_timestamp))")}
           AS customer_tenure_days,
         {big("EXTRACT(DAY FROM (SELECT as_of FROM m_as_of) - MAX(o.order_purchase_timestamp))")}
           AS days_since_last_order
  FROM m_customers c JOIN m_orders o ON c.customer_id = o.customer_id
       JOIN m_items i ON o.order_id = i.order_id
  WHERE o.order_status = 'Delivered'
  GROUP BY 1, 2, 3)
"""

DELIVERY = f"""
d_days AS (
  SELECT date_trunc('month', order_purchase_timestamp) AS month, order_delivered_customer_date AS arrived,
         EXTRACT(DAY FROM order_delivered_customer_date - order_purchase_timestamp) AS took,
         EXTRACT(DAY FROM order_estimated_delivery_date - order_purchase_timestamp) AS promised,
         EXTRACT(DAY FROM order_delivered_customer_date - order_estimated_delivery_date) AS late
  FROM m_deliveries WHERE order_purchase_timestamp IS NOT NULL),
v_delivery AS (
  SELECT month, {big("COUNT(*)")} AS total_orders, {big("COUNT(arrived)")} AS delivered_orders,
         {rnd(div("SUM(took)", "COUNT(took)"), 1)} AS avg_delivery_days,
         {rnd(div("SUM(promised)", "COUNT(promised)"), 1)} AS avg_estimated_days,
         {rnd(div("SUM(late)", "COUNT(late)"), 1)} AS avg_delay_days
  FROM d_days GROUP BY month)
"""


def monthly_revenue(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.monthly_revenue(mart.orders, mart.items))


def revenue_by_category(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.revenue_by_category(mart.items, mart.products))


def customer_summary(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.customer_summary(mart.customers, mart.orders, mart.items))


def order_status_breakdown(spark, folder):
    return plain(curated.order_status_breakdown(Mart(spark, folder).orders))


def top_products(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.top_products(mart.items, mart.products))


def best_sellers(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.top_products(mart.items, mart.products, k=10))


def revenue_by_state(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.revenue_by_state(mart.customers, mart.orders, mart.items))


def best_regions(spark, folder):
    return revenue_by_state(spark, folder).orderBy(F.desc("total_revenue"), "state").limit(10)


def delivery_performance(spark, folder):
    return plain(curated.delivery_performance(Mart(spark, folder).deliveries))


def delivery_status(spark, folder):
    return plain(curated.delivery_status(Mart(spark, folder).deliveries))


def month_vs_last_month(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.month_vs_last_month(mart.orders, mart.items))


def top_categories_last_month(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.top_categories_last_month(mart.orders, mart.items, mart.products))


def demand_last_30d(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.recent_demand(mart.orders, mart.items, mart.products))


def churn_risk_customers(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.churn_risk(curated.customer_summary(mart.customers, mart.orders, mart.items)))


def mom_growth(spark, folder):
    mart = Mart(spark, folder)
    return plain(curated.month_over_month(curated.monthly_revenue(mart.orders, mart.items)))


def _top_products_sql(k: int) -> str:
    return over_mart(f"""
SELECT i.product_id, p.product_category_name AS category,
       {big("COUNT(DISTINCT i.order_id)")} AS times_ordered,
       {rnd("SUM(i.price)")} AS total_revenue,
       {rnd(div("SUM(i.price)", "COUNT(i.price)"))} AS avg_price
FROM m_items i JOIN m_products p ON i.product_id = p.product_id
GROUP BY i.product_id, p.product_category_name
ORDER BY total_revenue DESC, i.product_id LIMIT {k}""")


_STATE = f"""
SELECT c.customer_state AS state,
       {big("COUNT(DISTINCT c.customer_unique_id)")} AS unique_customers,
       {big("COUNT(DISTINCT o.order_id)")} AS total_orders,
       {rnd("SUM(i.price)")} AS total_revenue,
       {rnd(div("SUM(i.price)", "COUNT(i.price)"))} AS avg_order_value,
       {rnd(div("SUM(i.price)", "COUNT(DISTINCT o.order_id)"))} AS true_aov
FROM m_customers c JOIN m_orders o ON c.customer_id = o.customer_id
     JOIN m_items i ON o.order_id = i.order_id
WHERE o.order_status = 'Delivered' GROUP BY c.customer_state
ORDER BY total_revenue DESC, state"""

QUERIES = {
    "monthly_revenue": (
        monthly_revenue,
        over_mart("SELECT * EXCLUDE (revenue) FROM v_monthly ORDER BY month", MONTHLY),
    ),
    "revenue_by_category": (
        revenue_by_category,
        over_mart(f"""
SELECT p.product_category_name AS category,
       {big("COUNT(DISTINCT i.order_id)")} AS total_orders,
       {big("COUNT(DISTINCT i.product_id)")} AS unique_products,
       {rnd("SUM(i.price)")} AS total_revenue,
       {rnd(div("SUM(i.price)", "COUNT(i.price)"))} AS avg_price,
       {rnd("CAST(SUM(i.price) AS DOUBLE) * 100 / NULLIF(CAST(SUM(SUM(i.price)) OVER () AS DOUBLE), 0)")}
         AS revenue_share_pct
FROM m_items i JOIN m_products p ON i.product_id = p.product_id
GROUP BY p.product_category_name"""),
    ),
    "customer_summary": (
        customer_summary,
        over_mart(
            "SELECT *, CAST(CASE WHEN days_since_last_order > 180 THEN 1 ELSE 0 END AS BIGINT)"
            " AS churn_label FROM v_customers",
            CUSTOMERS,
        ),
    ),
    "order_status_breakdown": (
        order_status_breakdown,
        over_mart(f"""
SELECT order_status, {big("COUNT(*)")} AS order_count,
       {rnd("CAST(COUNT(*) AS DOUBLE) * 100 / NULLIF(CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 0)")} AS percentage
FROM m_orders GROUP BY order_status"""),
    ),
    "top_products": (top_products, _top_products_sql(20)),
    "best_sellers": (best_sellers, _top_products_sql(10)),
    "revenue_by_state": (revenue_by_state, over_mart(_STATE)),
    "best_regions": (best_regions, over_mart(_STATE + " LIMIT 10")),
    "delivery_performance": (
        delivery_performance,
        over_mart("SELECT * FROM v_delivery ORDER BY month", DELIVERY),
    ),
    "delivery_status": (
        delivery_status,
        over_mart("""
SELECT month, avg_delivery_days, avg_estimated_days, avg_delay_days,
       CASE WHEN avg_delay_days > 3 THEN 'Significant Delays'
            WHEN avg_delay_days > 0 THEN 'Minor Delays'
            WHEN avg_delay_days <= 0 THEN 'On Time or Early' END AS delivery_status
FROM v_delivery ORDER BY month DESC LIMIT 12""", DELIVERY),
    ),
    "month_vs_last_month": (
        month_vs_last_month,
        over_mart(f"""
SELECT date_trunc('month', (SELECT as_of FROM m_as_of)) AS current_month,
       {rnd("SUM(CASE WHEN date_trunc('month', o.order_purchase_timestamp) = date_trunc('month', (SELECT as_of FROM m_as_of)) THEN i.price ELSE 0 END)")}
         AS revenue_this_month,
       {rnd("SUM(CASE WHEN date_trunc('month', o.order_purchase_timestamp) = date_trunc('month', (SELECT as_of FROM m_as_of)) - INTERVAL 1 MONTH THEN i.price ELSE 0 END)")}
         AS revenue_last_month
FROM m_orders o JOIN m_items i ON o.order_id = i.order_id"""),
    ),
    "top_categories_last_month": (
        top_categories_last_month,
        over_mart(f"""
SELECT p.product_category_name AS category, {big("COUNT(DISTINCT i.order_id)")} AS orders,
       {rnd("SUM(i.price)")} AS revenue
FROM m_items i JOIN m_products p ON i.product_id = p.product_id
     JOIN m_orders o ON i.order_id = o.order_id
WHERE o.order_status = 'Delivered' AND date_trunc('month', o.order_purchase_timestamp)
      = date_trunc('month', (SELECT as_of FROM m_as_of)) - INTERVAL 1 MONTH
GROUP BY 1 ORDER BY revenue DESC, category LIMIT 5"""),
    ),
    "demand_last_30d": (
        demand_last_30d,
        over_mart(f"""
SELECT p.product_category_name AS category, {big("COUNT(i.order_id)")} AS recent_orders,
       {rnd("SUM(i.price)")} AS recent_revenue
FROM m_items i JOIN m_products p ON i.product_id = p.product_id
     JOIN m_orders o ON i.order_id = o.order_id
WHERE o.order_purchase_timestamp >= (SELECT as_of FROM m_as_of) - INTERVAL 30 DAY
GROUP BY 1 ORDER BY recent_orders DESC, category LIMIT 10"""),
    ),
    "churn_risk_customers": (
        churn_risk_customers,
        over_mart("""
SELECT customer_unique_id, customer_state, total_orders, total_spend, days_since_last_order,
       CASE WHEN days_since_last_order > 180 THEN 'High Risk'
            WHEN days_since_last_order > 90 THEN 'Medium Risk' ELSE 'Active' END AS churn_risk
FROM v_customers WHERE days_since_last_order > 90
ORDER BY days_since_last_order DESC, customer_unique_id LIMIT 20""", CUSTOMERS),
    ),
    "mom_growth": (
        mom_growth,
        over_mart(f"""
SELECT month, total_revenue, CAST(LAG(revenue) OVER (ORDER BY month) AS DOUBLE) AS prev_month_revenue,
       {rnd("CAST(revenue - LAG(revenue) OVER (ORDER BY month) AS DOUBLE) * 100 / NULLIF(CAST(LAG(revenue) OVER (ORDER BY month) AS DOUBLE), 0)")}
         AS mom_growth_pct
FROM v_monthly""", MONTHLY),
    ),
}
