"""Catalogue: chart data, chart choice and insights."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from tablewise.catalog.common import big, over_mart, plain
from tablewise.catalog.metrics import TYPES
from tablewise.catalog.profiling import RAW
from tablewise.catalog.relations import _LINKS
from tablewise.operators import charts, insights, kpi, moments
from tablewise.operators.filters import DashboardFilters, apply_filters
from tablewise.operators.profile import profile_table
from tablewise.plans import chart_choice
from tablewise.session import per_table
from tablewise.sources.mart import Mart
from tablewise.sources.tables import read_table

WHEN = "order_purchase_timestamp"
YEAR = DashboardFilters(WHEN, dt.date(1998, 1, 1), dt.date(1998, 12, 31), "order_status", "Delivered")
HEAT = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


def _orders(spark, folder):
    return Mart(spark, folder).orders


def _sold(spark, folder):
    """Items with the category of their product."""
    mart = Mart(spark, folder)
    return mart.items.join(mart.products, "product_id", "inner")


def chart_line(spark, folder):
    return plain(charts.line(_orders(spark, folder), WHEN, "payment_value"))


def chart_line_average(spark, folder):
    data = charts.line(_orders(spark, folder), WHEN, "payment_value", aggregation="avg")
    return plain(data.withColumn("value", F.round("value", 6)))


def chart_line_grouped(spark, folder):
    return plain(charts.line(_orders(spark, folder), WHEN, "payment_value", "order_status"))


def chart_line_filtered(spark, folder):
    return plain(charts.line(apply_filters(_orders(spark, folder), YEAR), WHEN, "payment_value"))


def chart_bar(spark, folder):
    return plain(charts.bar(_sold(spark, folder), "product_id", "price", k=15))


def chart_bar_count(spark, folder):
    return plain(charts.bar(_orders(spark, folder), "customer_id", k=15))


def chart_pie(spark, folder):
    return plain(charts.pie(_orders(spark, folder), "order_priority"))


def chart_pie_other(spark, folder):
    return plain(charts.pie(read_table(spark, folder, "part"), "p_brand", slices=6))


def chart_treemap(spark, folder):
    return plain(charts.treemap(_sold(spark, folder), "product_id", "price", k=30))


def chart_funnel(spark, folder):
    return plain(charts.funnel(_orders(spark, folder), "order_status", "payment_value"))


def chart_histogram(spark, folder):
    return plain(charts.histogram(read_table(spark, folder, "lineitem"), "l_extendedprice"))


def chart_box(spark, folder):
    data = charts.box(read_table(spark, folder, "orders"), "o_totalprice")
    return data.withColumns({c: F.round(c, 6) for c in ("low", "q1", "median", "q3", "high")})


BOXES = ("low", "q1", "median", "q3", "high")


def chart_box_grouped(spark, folder):
    data = charts.box_grouped(read_table(spark, folder, "lineitem"), "l_extendedprice", "l_partkey")
    return data.withColumns({c: F.round(c, 6) for c in BOXES})


def chart_box_few_groups(spark, folder):
    data = charts.box_grouped(read_table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")
    return data.withColumns({c: F.round(c, 6) for c in BOXES})


def _box_sql(group: str) -> str:
    at = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    inner = ", ".join(f"ROUND(quantile_cont(l_extendedprice, {p}), 6) AS {name}" for name, p in at.items())
    return (
        f"SELECT 'l_extendedprice' AS x, CAST({group} AS VARCHAR) AS grp, {big('COUNT(l_extendedprice)')} AS value,"
        f" ROUND(MIN(l_extendedprice), 6) AS low, {inner}, ROUND(MAX(l_extendedprice), 6) AS high FROM lineitem GROUP BY {group}"
    )


def chart_heatmap(spark, folder):
    return charts.heatmap(read_table(spark, folder, "lineitem"), HEAT)


def _numbers(table: str) -> list[str]:
    return [spec.split(":")[0] for spec in RAW[table] if spec.endswith((":whole", ":real"))]


def heatmap_all_tables(spark, folder):
    """Correlations of the numeric columns of every table of the folder."""

    def one(name, df):
        return charts.heatmap(df, moments.numeric_columns(df)).select(F.lit(name).alias("table_name"), "*")

    frames = per_table(one, {t: read_table(spark, folder, t) for t in RAW if _numbers(t)})
    return reduce(lambda a, b: a.unionByName(b), frames.values())


def _heat_sql() -> str:
    def cell(t, a, b):
        spread = f"stddev_pop({a}) > 0 AND stddev_pop({b}) > 0"
        r = f"CASE WHEN {spread} THEN ROUND(corr(CAST({min(a, b)} AS DOUBLE), CAST({max(a, b)} AS DOUBLE)), 3) + 0.0 END"
        return f"SELECT '{t}' AS table_name, '{a}' AS x, '{b}' AS grp, {r} AS value FROM {t}"

    return "\nUNION ALL ".join(cell(t, a, b) for t in RAW for a in _numbers(t) for b in _numbers(t))


def chart_scatter_sample(spark, folder):
    return plain(charts.scatter(Mart(spark, folder).items, "price", "freight_value"))


def chart_cross_table(spark, folder):
    mart = Mart(spark, folder)
    return plain(charts.cross_table_line(mart.orders, mart.items, "order_id", "order_id", WHEN, "price"))


def _choice(spark, folder):
    mart = Mart(spark, folder, text_ids=True)
    tables = {"orders": mart.orders, "items": mart.items, "products": mart.products, "customers": mart.customers}
    profiles = per_table(lambda t, df: profile_table(df, t, samples=False), tables)
    return tables, chart_choice.choose_charts(profiles, _LINKS, tables)


def chart_selection(spark, folder):
    _, specs = _choice(spark, folder)
    return chart_choice.charts_to_frame(spark, "s1", specs).drop("session_id")


def fallback_insights(spark, folder):
    tables, specs = _choice(spark, folder)
    frames = [
        insights.fallback_insight(sample, s.chart_title, s.chart_type)
        for s in specs
        if s.source_table in tables and (sample := insights.chart_sample(s, tables[s.source_table])) is not None
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def insight_of_bars(spark, folder):
    data = charts.funnel(_orders(spark, folder), "order_status", "payment_value")
    return insights.fallback_insight(data, "Payment Value by Order Status", "bar")


def executive_summary(spark, folder):
    mart = Mart(spark, folder)
    metrics = kpi.calculate_metrics({"orders": mart.orders}, TYPES)
    text = insight_of_bars(spark, folder).withColumn("generated_at", F.lit(dt.datetime(2024, 1, 1)))
    return insights.executive_summary(metrics, text)


def _top(x: str, value: str, source: str, k: int | None = None) -> str:
    cut = f" LIMIT {k}" if k else ""
    return f"SELECT CAST({x} AS VARCHAR) AS x, {value} AS value FROM {source} GROUP BY 1 ORDER BY value DESC, x{cut}"


_PAY = "CAST(SUM(payment_value) AS DOUBLE)"
_MONTH = f"date_trunc('month', {WHEN})"
_COUNT = "CAST(COUNT(*) AS DOUBLE)"
_SOLD = "m_items i JOIN m_products p ON i.product_id = p.product_id"
_INSIGHT = f"""
segments AS (SELECT order_status AS x, {_PAY} AS value FROM m_orders GROUP BY 1),
insight AS (SELECT (SELECT x FROM segments ORDER BY value DESC, x LIMIT 1) || ' leads with '
  || format('{{:,.2f}}', MAX(value)) || ', ' || printf('%.1f', MAX(value) / SUM(value) * 100)
  || '% of the sum over ' || COUNT(*)
  || ' groups.' AS insight_text FROM segments)"""
_PARTS = "SELECT p_brand AS x, CAST(COUNT(*) AS DOUBLE) AS value FROM part GROUP BY 1 ORDER BY value DESC, x LIMIT 5"
_HEAT_CELLS = "\nUNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS grp, ROUND(corr({min(a, b)}, {max(a, b)}), 3) + 0.0 AS value FROM lineitem"
    for a in HEAT
    for b in HEAT
)

QUERIES = {
    "chart_line": (
        chart_line, over_mart(f"SELECT {_MONTH} AS x, {_PAY} AS value FROM m_orders GROUP BY 1 ORDER BY 1"),
    ),
    "chart_line_average": (
        chart_line_average,
        over_mart(
            f"SELECT {_MONTH} AS x, ROUND({_PAY} / COUNT(*), 6) AS value FROM m_orders GROUP BY 1 ORDER BY 1"
        ),
    ),
    "chart_line_grouped": (
        chart_line_grouped,
        over_mart(
            f"SELECT {_MONTH} AS x, order_status AS grp, {_PAY} AS value FROM m_orders GROUP BY 1, 2 ORDER BY 1, 2"
        ),
    ),
    "chart_line_filtered": (
        chart_line_filtered,
        over_mart(
            f"SELECT {_MONTH} AS x, {_PAY} AS value FROM m_orders WHERE CAST({WHEN} AS DATE) >= DATE '1998-01-01'"
            f" AND CAST({WHEN} AS DATE) <= DATE '1998-12-31' AND order_status = 'Delivered' GROUP BY 1 ORDER BY 1"
        ),
    ),
    "chart_bar": (chart_bar, over_mart(_top("i.product_id", "CAST(SUM(i.price) AS DOUBLE)", _SOLD, 15))),
    "chart_bar_count": (chart_bar_count, over_mart(_top("customer_id", _COUNT, "m_orders", 15))),
    "chart_pie": (chart_pie, over_mart(_top("order_priority", _COUNT, "m_orders"))),
    "chart_pie_other": (
        chart_pie_other,
        f"WITH head AS ({_PARTS}) SELECT * FROM head UNION ALL SELECT 'Other', CAST((SELECT COUNT(*) FROM part)"
        " - SUM(value) AS DOUBLE) FROM head HAVING (SELECT COUNT(*) FROM part) > SUM(value)",
    ),
    "chart_treemap": (chart_treemap, over_mart(_top("i.product_id", "CAST(SUM(i.price) AS DOUBLE)", _SOLD, 30))),
    "chart_funnel": (chart_funnel, over_mart(_top("order_status", _PAY, "m_orders"))),
    "chart_histogram": (
        chart_histogram,
        f"""WITH b AS (SELECT MIN(l_extendedprice) AS lo, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 30 AS w FROM lineitem),
c AS (SELECT LEAST(CAST(FLOOR((l_extendedprice - lo) / w) AS BIGINT), 29) AS bin, COUNT(*) AS n FROM lineitem, b GROUP BY 1)
SELECT bin, lo + bin * w AS lower, lo + (bin + 1) * w AS upper, {big("n")} AS value FROM c, b""",
    ),
    "chart_box": (
        chart_box,
        f"""SELECT 'o_totalprice' AS x, {big("COUNT(o_totalprice)")} AS value, ROUND(MIN(o_totalprice), 6) AS low,
  ROUND(quantile_cont(o_totalprice, 0.25), 6) AS q1, ROUND(quantile_cont(o_totalprice, 0.5), 6) AS median,
  ROUND(quantile_cont(o_totalprice, 0.75), 6) AS q3, ROUND(MAX(o_totalprice), 6) AS high FROM orders""",
    ),
    "chart_box_grouped": (chart_box_grouped, _box_sql("l_partkey")),
    "chart_box_few_groups": (chart_box_few_groups, _box_sql("l_returnflag")),
    "chart_heatmap": (chart_heatmap, _HEAT_CELLS),
    "heatmap_all_tables": (heatmap_all_tables, _heat_sql()),
    "chart_scatter_sample": (chart_scatter_sample, None),
    "chart_cross_table": (
        chart_cross_table,
        over_mart(
            f"SELECT date_trunc('month', o.{WHEN}) AS x, CAST(SUM(i.price) AS DOUBLE) AS value"
            " FROM m_orders o JOIN m_items i ON o.order_id = i.order_id GROUP BY 1 ORDER BY 1"
        ),
    ),
    "chart_selection": (chart_selection, None),
    "fallback_insights": (fallback_insights, None),
    "insight_of_bars": (
        insight_of_bars,
        over_mart(
            "SELECT 'Payment Value by Order Status' AS chart_title, 'bar' AS chart_type, insight_text FROM insight",
            _INSIGHT,
        ),
    ),
    "executive_summary": (
        executive_summary,
        over_mart(
            "SELECT 'Revenue per Customer is ' || format('{:,.2f}', ROUND(CAST(SUM(payment_value) AS DOUBLE)"
            " / COUNT(DISTINCT customer_id), 2)) || ' currency. ' || (SELECT insight_text FROM insight) AS summary"
            " FROM m_orders",
            _INSIGHT,
        ),
    ),
}
