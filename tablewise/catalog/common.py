"""Shared pieces of the query catalogue: plain output types and SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, integers as longs, dates as text: one type per kind of value."""

    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return c.cast("long").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        return c

    return df.select(*(column(f) for f in df.schema.fields))


def rnd(expression: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(28,6)), {digits}) AS DOUBLE)"


def div(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


MART = """
m_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Shipped'
              WHEN 'P' THEN 'Processing' ELSE o_orderstatus END AS order_status,
         o_orderpriority AS order_priority, o_orderdate AS order_purchase_timestamp,
         CAST(o_totalprice AS DECIMAL(18,2)) AS payment_value
  FROM orders),
m_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
         l_linenumber AS order_item_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS freight_value
  FROM lineitem),
m_products AS (SELECT p_partkey AS product_id, p_type AS product_category_name FROM part),
m_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, c_mktsegment AS customer_city,
         n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
m_deliveries AS (
  SELECT o.order_id, o.order_status, o.order_purchase_timestamp,
         CASE WHEN o.order_status = 'Delivered' THEN s.last_shipment END
           AS order_delivered_customer_date,
         o.order_purchase_timestamp + INTERVAL 30 DAY AS order_estimated_delivery_date
  FROM m_orders o LEFT JOIN (
    SELECT l_orderkey AS order_id, MAX(l_shipdate) AS last_shipment FROM lineitem GROUP BY 1) s
  ON o.order_id = s.order_id),
m_as_of AS (SELECT MAX(order_purchase_timestamp) AS as_of FROM m_orders)
"""


def over_mart(body: str, *more: str) -> str:
    """A query over the order mart, with further named parts before it."""
    return "WITH " + ",\n".join([MART.strip(), *(m.strip() for m in more)]) + "\n" + body.strip()
