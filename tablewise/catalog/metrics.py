"""Catalogue: metrics, period comparison, alerts and scenarios."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablewise.catalog.common import over_mart, plain, rnd
from tablewise.catalog.relations import ITEM_TYPES, ORDER_TYPES
from tablewise.operators import compare, kpi
from tablewise.operators.filters import DashboardFilters, apply_preset
from tablewise.sources.mart import Mart

PRODUCT_TYPES = {"product_id": "id", "product_category_name": "category"}
CUSTOMER_TYPES = {
    "customer_id": "id", "customer_unique_id": "id", "customer_city": "category", "customer_state": "category",
}
TYPES = {"orders": ORDER_TYPES, "items": ITEM_TYPES, "products": PRODUCT_TYPES, "customers": CUSTOMER_TYPES}
COLUMNS = ("kpi_name", "kpi_value", "kpi_unit", "kpi_category", "tier", "confidence", "table_name")
PERIOD = DashboardFilters("order_purchase_timestamp", dt.date(2000, 3, 1), dt.date(2000, 5, 31))
SHORT_PERIOD = DashboardFilters("order_purchase_timestamp", dt.date(2000, 3, 15), dt.date(2000, 3, 16))
FILTER = DashboardFilters(
    "order_purchase_timestamp", dt.date(1997, 1, 1), dt.date(1999, 12, 31), "order_priority", "2-HIGH"
)
SCENARIOS = {"growth": {"revenue": 0.2, "orders": -0.1}, "slump": {"Total Revenue": -15, "total_customers": -5}}


def _tables(spark, folder, *names):
    mart = Mart(spark, folder)
    every = {"orders": mart.orders, "items": mart.items, "products": mart.products, "customers": mart.customers}
    return {n: every[n] for n in names}


def _metrics(spark, folder, *names, filters=None):
    return kpi.calculate_metrics(_tables(spark, folder, *names), TYPES, filters)


def kpis_orders(spark, folder):
    return plain(_metrics(spark, folder, "orders").select(*COLUMNS))


def kpis_items(spark, folder):
    return plain(_metrics(spark, folder, "items").select(*COLUMNS))


def kpis_session(spark, folder):
    return plain(_metrics(spark, folder, "orders", "items", "products", "customers").select(*COLUMNS))


def kpis_filtered(spark, folder):
    return plain(_metrics(spark, folder, "orders", filters=FILTER).select(*COLUMNS))


def kpi_cards(spark, folder):
    from tablewise.functions.columns import compact_value, display_value

    metrics = _metrics(spark, folder, "orders")
    return metrics.select(
        "kpi_name", display_value(F.col("kpi_value"), F.col("kpi_unit")).alias("display"),
        compact_value(F.col("kpi_value")).alias("compact"),
    )


def preset_counts(spark, folder):
    orders = Mart(spark, folder).orders
    frames = [
        apply_preset(orders, "order_purchase_timestamp", preset).agg(F.count("*").alias("orders")).select(
            F.lit(preset).alias("preset"), "orders"
        )
        for preset in ("30d", "90d", "12m", "all")
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _comparison(spark, folder):
    return compare.compare_periods(_tables(spark, folder, "orders"), TYPES, PERIOD)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("decimal(28,6)"), 4).cast("double") for c in columns})


_CHANGES = ("current_value", "previous_value", "absolute_change", "percent_change")


def period_comparison(spark, folder):
    return _rounded(_comparison(spark, folder), *_CHANGES)


def monitoring_window(spark, folder):
    window = compare.monitoring_window(_tables(spark, folder, "orders"), TYPES)
    rows = [(window[0], str(window[1]), str(window[2]))] if window else []
    return spark.createDataFrame(rows, "date_column string, date_from string, date_to string")


def _alerts(spark, folder, filters=None):
    alerts = compare.evaluate_alerts(_tables(spark, folder, "orders"), TYPES, filters)
    return alerts.select(
        "event_type", "severity", "kpi_name", "title", "message", "recommendation", "period_from", "period_to"
    )


def kpi_alerts(spark, folder):
    return _alerts(spark, folder)


def kpi_alerts_period(spark, folder):
    return _alerts(spark, folder, SHORT_PERIOD)


def related_movements(spark, folder):
    return _rounded(compare.related_movements(_comparison(spark, folder)), "related_percent", "related_absolute")


def what_if(spark, folder):
    projected = compare.what_if(_metrics(spark, folder, "orders"), SCENARIOS)
    return plain(_rounded(projected, "base_value", "adjustment_pct").drop("rank"))


def scenario_summaries(spark, folder):
    return compare.scenario_summaries(compare.what_if(_metrics(spark, folder, "orders"), SCENARIOS))


def _orders_sql(where: str) -> str:
    """Metrics of the orders table under a condition, one row per metric."""
    return f"""
SELECT 'Total Revenue' AS kpi_name, CAST(ROUND(SUM(payment_value), 2) AS DOUBLE) AS kpi_value, 'currency' AS kpi_unit, 'sales' AS kpi_category, 1 AS tier FROM m_orders WHERE {where}
UNION ALL SELECT 'Avg Order Value', CAST(SUM(payment_value) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0), 'currency', 'sales', 1 FROM m_orders WHERE {where}
UNION ALL SELECT 'Max Transaction', CAST(MAX(payment_value) AS DOUBLE), 'currency', 'sales', 2 FROM m_orders WHERE {where}
UNION ALL SELECT 'Total Orders', CAST(COUNT(DISTINCT order_id) AS DOUBLE), 'count', 'sales', 1 FROM m_orders WHERE {where}
UNION ALL SELECT 'Total Customers', CAST(COUNT(DISTINCT customer_id) AS DOUBLE), 'count', 'customer', 1 FROM m_orders WHERE {where}
UNION ALL SELECT 'Revenue per Customer', {rnd("CAST(SUM(payment_value) AS DOUBLE) / NULLIF(COUNT(DISTINCT customer_id), 0)")}, 'currency', 'customer', 1 FROM m_orders WHERE {where}
UNION ALL SELECT 'Data Time Span', NULLIF(CAST(EXTRACT(DAY FROM MAX(order_purchase_timestamp) - MIN(order_purchase_timestamp)) AS DOUBLE), 0), 'days', 'general', 2 FROM m_orders WHERE {where}
UNION ALL SELECT 'Delivery Rate', {rnd("CAST(COUNT(DISTINCT CASE WHEN lower(trim(order_status)) = 'delivered' THEN order_id END) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0) * 100", 1)}, 'percent', 'sales', 1 FROM m_orders WHERE {where}"""


_ITEMS_SQL = """
SELECT 'Total Orders' AS kpi_name, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS kpi_value, 'count' AS kpi_unit, 'sales' AS kpi_category, 1 AS tier FROM m_items
UNION ALL SELECT 'Total Products', CAST(COUNT(DISTINCT product_id) AS DOUBLE), 'count', 'inventory', 1 FROM m_items
UNION ALL SELECT 'Active Sellers', CAST(COUNT(DISTINCT seller_id) AS DOUBLE), 'count', 'sales', 1 FROM m_items"""

_PRODUCTS_SQL = """
SELECT 'Product Categories' AS kpi_name, CAST(COUNT(DISTINCT product_category_name) AS DOUBLE) AS kpi_value, 'count' AS kpi_unit, 'inventory' AS kpi_category, 2 AS tier FROM m_products"""

_CONFIDENCE = """ROUND(GREATEST(0.5, LEAST(0.99, CAST(0.68 AS DOUBLE)
  + CASE WHEN regexp_matches(lower(kpi_name), 'revenue|orders|customers') THEN 0.12 ELSE 0 END
  + CASE WHEN lower(kpi_name) LIKE '%rate%' OR kpi_unit = 'percent' THEN 0.05 ELSE 0 END
  + CASE WHEN lower(kpi_name) LIKE '%avg%' THEN 0.04 ELSE 0 END
  - CASE WHEN kpi_value = 0 THEN 0.15 ELSE 0 END - CASE WHEN kpi_value < 0 THEN 0.05 ELSE 0 END)), 2)"""


def _final(parts, table: str) -> str:
    return over_mart(
        f"""SELECT kpi_name, kpi_value, kpi_unit, kpi_category, CAST(tier AS BIGINT) AS tier,
  CAST({_CONFIDENCE} AS DOUBLE) AS confidence, {table} AS table_name FROM k WHERE kpi_value IS NOT NULL""",
        f"k AS ({parts})",
    )


_CUR = "order_purchase_timestamp >= DATE '2000-03-01' AND order_purchase_timestamp < DATE '2000-06-01'"
_PREV = "order_purchase_timestamp >= DATE '1999-11-30' AND order_purchase_timestamp < DATE '2000-03-01'"


def _compared(current: str, previous: str) -> str:
    return f"""
cur AS ({_orders_sql(current)}), prev AS ({_orders_sql(previous)}),
cmp AS (SELECT c.kpi_name, c.kpi_value AS current_value, p.kpi_value AS previous_value,
  c.kpi_value - p.kpi_value AS absolute_change,
  (c.kpi_value - p.kpi_value) / NULLIF(ABS(p.kpi_value), 0) * 100 AS percent_change,
  CASE WHEN c.kpi_value > p.kpi_value THEN 'up' WHEN c.kpi_value < p.kpi_value THEN 'down' ELSE 'flat' END AS direction
  FROM cur c JOIN prev p ON c.kpi_name = p.kpi_name WHERE c.kpi_value IS NOT NULL AND p.kpi_value IS NOT NULL)"""


_MONITOR = "monitor AS (SELECT CAST(MIN(order_purchase_timestamp) AS DATE) AS first, CAST(MAX(order_purchase_timestamp) AS DATE) AS last FROM m_orders)"
_NOW = "order_purchase_timestamp >= (SELECT last - 29 FROM monitor) AND order_purchase_timestamp < (SELECT last + 1 FROM monitor)"
_BEFORE = "order_purchase_timestamp >= (SELECT last - 59 FROM monitor) AND order_purchase_timestamp < (SELECT last - 29 FROM monitor)"

_ALERTS = """
judged AS (SELECT *, lower(kpi_name) LIKE '%rate%' AS is_rate,
  CASE WHEN lower(kpi_name) LIKE '%rate%' THEN ABS(absolute_change) ELSE ABS(percent_change) END AS moved,
  CASE WHEN lower(kpi_name) LIKE '%rate%' THEN 10 WHEN lower(kpi_name) LIKE '%revenue%' THEN 20 ELSE 25 END AS low,
  CASE WHEN lower(kpi_name) LIKE '%rate%' THEN 15 WHEN lower(kpi_name) LIKE '%revenue%' THEN 30 ELSE 37.5 END AS medium,
  CASE WHEN lower(kpi_name) LIKE '%rate%' THEN 20 WHEN lower(kpi_name) LIKE '%revenue%' THEN 40 ELSE 50 END AS high
  FROM cmp WHERE percent_change IS NOT NULL),
named AS (SELECT *, CASE WHEN moved >= high THEN 'high' WHEN moved >= medium THEN 'medium' ELSE 'low' END AS severity,
  kpi_name || CASE WHEN direction = 'up' THEN ' increased ' ELSE ' decreased ' END || printf('%.1f', moved)
    || CASE WHEN is_rate THEN ' percentage points' ELSE '%' END AS title FROM judged WHERE moved >= low)"""



def _alert_rows(first: str, last: str) -> str:
    return f"""
SELECT 'business_alert_' || severity AS event_type, severity, kpi_name, title,
  title || ' from ' || format('{{:,.2f}}', previous_value) || ' to ' || format('{{:,.2f}}', current_value) || ' between '
    || {first} || ' and ' || {last} || ', against the period before.' AS message,
  CASE WHEN lower(kpi_name) LIKE '%revenue%' THEN 'Break sales down by product and by region to see where the change comes from.'
    WHEN lower(kpi_name) LIKE '%order%' THEN 'Compare demand, deliveries and cancelled orders of both periods.'
    WHEN is_rate THEN 'Look into the work that this rate measures.'
    WHEN direction = 'down' THEN 'Find out what fell, and whether all data of the period has arrived.'
    ELSE 'Find out what rose, and whether data was loaded twice.' END AS recommendation,
  {first} AS period_from, {last} AS period_to
FROM named"""


_CHANGED_SQL = ", ".join(f"{rnd(c, 4)} AS {c}" for c in _CHANGES)

_SCENARIO = f"""
k AS ({_orders_sql("TRUE")}),
given AS (SELECT * FROM (VALUES ('growth', 'Total Revenue', 0.2), ('growth', 'Total Orders', -0.1),
  ('slump', 'Total Revenue', -15.0), ('slump', 'Total Customers', -5.0)) AS g(scenario, kpi_name, change)),
projected AS (
  SELECT s.scenario, k.kpi_name, k.kpi_value AS base_value,
    CASE WHEN ABS(COALESCE(g.change, 0)) > 1 THEN g.change / 100 ELSE COALESCE(CAST(g.change AS DOUBLE), 0) END AS share,
    {_CONFIDENCE.replace('kpi_name', 'k.kpi_name')} AS confidence
  FROM k CROSS JOIN (SELECT DISTINCT scenario FROM given) s
  LEFT JOIN given g ON g.scenario = s.scenario AND g.kpi_name = k.kpi_name WHERE k.kpi_value IS NOT NULL)"""

QUERIES = {
    "kpis_orders": (kpis_orders, _final(_orders_sql("TRUE"), "'orders'")),
    "kpis_items": (kpis_items, _final(_ITEMS_SQL, "'items'")),
    "kpis_filtered": (
        kpis_filtered,
        _final(
            _orders_sql(
                "order_purchase_timestamp >= DATE '1997-01-01' AND order_purchase_timestamp < DATE '2000-01-01'"
                " AND order_priority = '2-HIGH'"
            ),
            "'orders'",
        ),
    ),
    "kpis_session": (
        kpis_session,
        over_mart(
            f"""SELECT kpi_name, kpi_value, kpi_unit, kpi_category, CAST(tier AS BIGINT) AS tier,
  CAST({_CONFIDENCE} AS DOUBLE) AS confidence, table_name FROM k WHERE kpi_value IS NOT NULL
ORDER BY tier, CASE kpi_category WHEN 'sales' THEN 0 WHEN 'customer' THEN 1 WHEN 'inventory' THEN 2 ELSE 3 END,
  kpi_name""",
            f"""k AS (SELECT *, 'orders' AS table_name FROM ({_orders_sql("TRUE")})
  UNION ALL SELECT *, 'items' FROM ({_ITEMS_SQL}) WHERE kpi_name <> 'Total Orders'
  UNION ALL SELECT *, 'products' FROM ({_PRODUCTS_SQL}))""",
        ),
    ),
    "kpi_cards": (
        kpi_cards,
        over_mart(
            """SELECT kpi_name, CASE kpi_unit WHEN 'currency' THEN '$' || format('{:,.2f}', kpi_value)
  WHEN 'count' THEN format('{:,.0f}', kpi_value) WHEN 'percent' THEN format('{:.1f}%', kpi_value)
  ELSE format('{:.0f} days', kpi_value) END AS display,
  CASE WHEN kpi_value >= 1e9 THEN format('{:.1f}B', kpi_value / 1e9) WHEN kpi_value >= 1e6 THEN format('{:.1f}M', kpi_value / 1e6)
  WHEN kpi_value >= 1e3 THEN format('{:.1f}K', kpi_value / 1e3) ELSE format('{:,.2f}', kpi_value) END AS compact FROM k""",
            f"k AS ({_orders_sql('TRUE')})",
        ),
    ),
    "preset_counts": (
        preset_counts,
        over_mart("""
SELECT preset, COUNT(*) AS orders FROM m_orders, m_as_of, (VALUES ('30d'), ('90d'), ('12m'), ('all')) AS p(preset)
WHERE CASE preset WHEN '30d' THEN CAST(order_purchase_timestamp AS DATE) >= CAST(as_of AS DATE) - 29
  WHEN '90d' THEN CAST(order_purchase_timestamp AS DATE) >= CAST(as_of AS DATE) - 89
  WHEN '12m' THEN CAST(order_purchase_timestamp AS DATE) >= CAST(as_of AS DATE) - INTERVAL 12 MONTH ELSE TRUE END
GROUP BY preset"""),
    ),
    "period_comparison": (
        period_comparison,
        over_mart(f"SELECT kpi_name, {_CHANGED_SQL}, direction FROM cmp", _compared(_CUR, _PREV)),
    ),
    "monitoring_window": (
        monitoring_window,
        over_mart(
            "SELECT 'order_purchase_timestamp' AS date_column, CAST(last - 29 AS VARCHAR) AS date_from,"
            " CAST(last AS VARCHAR) AS date_to FROM monitor WHERE last - first >= 59",
            _MONITOR,
        ),
    ),
    "kpi_alerts": (
        kpi_alerts,
        over_mart(
            _alert_rows(
                "(SELECT CAST(last - 29 AS VARCHAR) FROM monitor)", "(SELECT CAST(last AS VARCHAR) FROM monitor)"
            ),
            _MONITOR, _compared(_NOW, _BEFORE), _ALERTS,
        ),
    ),
    "kpi_alerts_period": (
        kpi_alerts_period,
        over_mart(
            _alert_rows("'2000-03-15'", "'2000-03-16'"),
            _compared(
                "order_purchase_timestamp >= DATE '2000-03-15' AND order_purchase_timestamp < DATE '2000-03-17'",
                "order_purchase_timestamp >= DATE '2000-03-13' AND order_purchase_timestamp < DATE '2000-03-15'",
            ),
            _ALERTS,
        ),
    ),
    "related_movements": (
        related_movements,
        over_mart(f"""
SELECT a.kpi_name, b.kpi_name AS related_name, a.direction, {rnd("b.percent_change", 4)} AS related_percent,
  {rnd("b.absolute_change", 4)} AS related_absolute,
  CASE WHEN lower(b.kpi_name) LIKE '%rate%' THEN 'percentage points' ELSE '%' END AS unit
FROM cmp a JOIN cmp b ON a.direction = b.direction AND a.kpi_name <> b.kpi_name
WHERE CASE WHEN lower(a.kpi_name) LIKE '%revenue%' THEN regexp_matches(lower(b.kpi_name), 'order|delivery rate')
  WHEN lower(a.kpi_name) LIKE '%order%' THEN regexp_matches(lower(b.kpi_name), 'revenue|delivery rate')
  WHEN lower(a.kpi_name) LIKE '%rate%' THEN regexp_matches(lower(b.kpi_name), 'order|revenue') ELSE FALSE END""",
            _compared(_CUR, _PREV)),
    ),
    "what_if": (
        what_if,
        over_mart(f"""
SELECT scenario, kpi_name, {rnd("base_value", 4)} AS base_value, {rnd("share * 100", 4)} AS adjustment_pct,
  {rnd("base_value * (1 + share)")} AS projected_value, {rnd("share * 100")} AS delta_pct,
  CAST(confidence AS DOUBLE) AS confidence FROM projected""", _SCENARIO),
    ),
    "scenario_summaries": (
        scenario_summaries,
        over_mart("""
SELECT scenario, CASE WHEN kpi_name = 'Total Revenue' THEN 'Revenue' ELSE kpi_name END || ': '
  || CASE WHEN share > 0 THEN 'a rise' ELSE 'a fall' END || ' of ' || printf('%.1f', ABS(share * 100))
  || '% in this scenario.' AS summary
FROM projected QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY ABS(share) DESC) = 1""", _SCENARIO),
    ),
}
