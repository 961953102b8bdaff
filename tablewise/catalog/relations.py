"""Catalogue: relationships, join views and generated views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.catalog.common import big, div, over_mart, plain, rnd
from tablewise.catalog.profiling import KEYED_SQL, RAW
from tablewise.operators import joins, key_search, profile, relate
from tablewise.operators.profile import profile_table
from tablewise.plans import generated
from tablewise.session import per_table
from tablewise.sources.mart import Mart
from tablewise.sources.tables import read_table

ITEM_TYPES = {
    "order_id": "id", "product_id": "id", "seller_id": "id", "order_item_id": "numeric",
    "price": "currency", "freight_value": "currency",
}
ORDER_TYPES = {
    "order_id": "id", "customer_id": "id", "order_status": "category", "order_priority": "category",
    "order_purchase_timestamp": "datetime", "payment_value": "currency",
}


def _keyed(spark, folder):
    mart = Mart(spark, folder, text_ids=True)
    return {"s_items": mart.items, "s_orders": mart.orders, "s_customers": mart.customers, "s_products": mart.products}


def _profiled(tables):
    return per_table(lambda t, df: profile_table(df, t, samples=False), tables)


PAIRS = [
    (("s_items", "order_id"), ("s_orders", "order_id")),
    (("s_items", "product_id"), ("s_products", "product_id")),
    (("s_orders", "customer_id"), ("s_customers", "customer_id")),
    (("s_orders", "customer_id"), ("s_customers", "customer_unique_id")),
]


def fk_match(spark, folder):
    matched = relate.match_share(relate.key_overlap(_keyed(spark, folder), PAIRS))
    return plain(matched.drop("pair").withColumns({c: F.round(c, 8) for c in ("match", "reverse_match")}))


def relationships(spark, folder):
    tables = _keyed(spark, folder)
    return relate.relationship_frame(tables, _profiled(tables))


def relationships_contained(spark, folder):
    tables = _keyed(spark, folder)
    reordered = {t: tables[t] for t in ("s_products", "s_customers", "s_orders", "s_items")}
    return relate.relationship_frame(reordered, _profiled(reordered), orient="contained")


def join_view(spark, folder):
    mart = Mart(spark, folder)
    return plain(joins.join_view(mart.items, mart.orders, "order_id", "order_id"))


_LINKS = (
    relate.Relationship("items", "order_id", "orders", "order_id", "high", 100.0, "view_items_orders"),
    relate.Relationship("items", "product_id", "products", "product_id", "high", 100.0, "view_items_products"),
    relate.Relationship("orders", "customer_id", "customers", "customer_id", "high", 100.0, "view_orders_customers"),
)


def _star_tables(spark, folder):
    mart = Mart(spark, folder)
    return {"items": mart.items, "orders": mart.orders, "products": mart.products, "customers": mart.customers}


def master_view(spark, folder):
    return plain(joins.master_enriched(_star_tables(spark, folder), _LINKS))


def master_view_fan_out(spark, folder):
    """The star around orders, whose item rows repeat the order row."""
    links = (_LINKS[2], _LINKS[0])
    return plain(joins.master_fact_rows(_star_tables(spark, folder), links))


def view_time_series(spark, folder):
    return plain(generated.time_series(Mart(spark, folder).orders, "order_purchase_timestamp", "payment_value"))


def view_by_category(spark, folder):
    return plain(generated.by_category(Mart(spark, folder).orders, "order_status", "payment_value"))


def view_entity_summary(spark, folder):
    return plain(generated.entity_summary(Mart(spark, folder).orders, "customer_id", "payment_value"))


def view_summary(spark, folder):
    return plain(generated.table_summary(Mart(spark, folder).items))


_MEASURES = f"""{rnd("SUM(payment_value)")} AS total_value, {rnd(div("SUM(payment_value)", "COUNT(*)"))} AS avg_value"""
_RANGE = f"""{rnd("MIN(payment_value)")} AS min_value, {rnd("MAX(payment_value)")} AS max_value"""


def _distinct_overlap(a, b) -> str:
    (ft, fc), (tt, tc) = a, b
    return f"""
SELECT '{ft}' AS from_table, '{fc}' AS from_column, '{tt}' AS to_table, '{tc}' AS to_column,
       (SELECT COUNT(DISTINCT {fc}) FROM k_{ft}) AS from_keys, (SELECT COUNT(DISTINCT {tc}) FROM k_{tt}) AS to_keys,
       (SELECT COUNT(DISTINCT {fc}) FROM k_{ft} WHERE {fc} IN (SELECT {tc} FROM k_{tt})) AS shared"""


_KEYED = KEYED_SQL.strip() + """,
k_s_items AS (SELECT * FROM keyed_items), k_s_orders AS (SELECT * FROM keyed_orders),
k_s_customers AS (SELECT * FROM keyed_customers), k_s_products AS (SELECT * FROM keyed_products)"""


def _overlap_sql(pairs) -> str:
    return (
        "WITH " + _KEYED + ",\noverlap AS (" + "\nUNION ALL".join(_distinct_overlap(a, b) for a, b in pairs) + "),\n"
        "matched AS (SELECT *, CAST(shared AS DOUBLE) / from_keys AS match, CAST(shared AS DOUBLE) / to_keys"
        " AS reverse_match FROM overlap)\n"
    )


# pairs of id columns with matching names; the types come from the rules (semantic_types)
_LISTED = [PAIRS[0], PAIRS[1], PAIRS[2], PAIRS[3]]
_TURNED = [(b, a) for a, b in _LISTED]
_REL = f"""CASE WHEN match >= 0.8 THEN 'high' WHEN match >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  {rnd("match * 100")} AS match_percent"""

def schema_with_relationships(spark, folder):
    """The nested schema of a session of text keys, each table with its columns and the relationships it takes part in."""
    tables = _keyed(spark, folder)
    profiles = _profiled(tables)
    found = relate.relationship_frame(tables, profiles)
    nested = profile.nested_schema(profile.profiles_to_frame(spark, profiles), relationships=found)
    link = F.transform("relationships", lambda r: F.concat_ws(" ", r["from_table"], r["from_column"], r["to_table"], r["to_column"], r["confidence"]))
    names = F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["detected_type"]))
    return nested.select("table_name", F.array_join(names, "|").alias("columns"), F.array_join(link, "|").alias("relationships"))


KEY_COLUMNS = {
    t: [spec.split(":")[0] for spec in specs if spec.endswith("key:whole") or spec.endswith("id:whole")] for t, specs in RAW.items()
}


def key_containments(spark, folder):
    """Every pair of key columns of the folder of which one holds half of the other's values or more, names left aside."""
    columns = {t: names for t, names in KEY_COLUMNS.items() if names}
    found = key_search.containments({t: read_table(spark, folder, t) for t in columns}, columns)
    return found.withColumn("match", F.round("match", 6))


def _containments_sql() -> str:
    values = "\nUNION ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, names in KEY_COLUMNS.items() for c in names
    )
    return f"""WITH held AS ({values}),
sizes AS (SELECT t, c, COUNT(*) AS n FROM held GROUP BY t, c),
shared AS (SELECT a.t AS at_, a.c AS ac, b.t AS bt, b.c AS bc, COUNT(*) AS n FROM held a JOIN held b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT s.at_ AS from_table, s.ac AS from_column, s.bt AS to_table, s.bc AS to_column, {big("x.n")} AS from_keys, {big("y.n")} AS to_keys,
  {big("s.n")} AS shared, ROUND(CAST(s.n AS DOUBLE) / x.n, 6) AS match
FROM shared s JOIN sizes x ON x.t = s.at_ AND x.c = s.ac JOIN sizes y ON y.t = s.bt AND y.c = s.bc WHERE 2 * s.n >= x.n"""


QUERIES = {
    "schema_with_relationships": (schema_with_relationships, None),
    "key_containments": (key_containments, _containments_sql()),
    "fk_match": (
        fk_match,
        _overlap_sql(PAIRS) + f"""SELECT from_table, from_column, to_table, to_column, {big("from_keys")} AS from_keys,
  {big("to_keys")} AS to_keys, {big("shared")} AS shared, ROUND(match, 8) AS match,
  ROUND(reverse_match, 8) AS reverse_match FROM matched""",
    ),
    "relationships": (
        relationships,
        _overlap_sql(_LISTED) + f"""SELECT from_table, from_column, to_table, to_column, {_REL},
  'view_s_' || substr(from_table, 3) || '_' || substr(to_table, 3) AS view_name FROM matched WHERE match >= 0.5""",
    ),
    "relationships_contained": (
        relationships_contained,
        _overlap_sql(_LISTED) + f"""SELECT from_table, from_column, to_table, to_column, {_REL},
  'view_s_' || substr(from_table, 3) || '_' || substr(to_table, 3) AS view_name FROM matched
  WHERE match >= 0.5""",
    ),
    "join_view": (
        join_view,
        over_mart(f"""
SELECT i.order_id, i.product_id, i.seller_id, {big("i.order_item_id")} AS order_item_id,
       CAST(i.price AS DOUBLE) AS price, CAST(i.freight_value AS DOUBLE) AS freight_value,
       o.customer_id, o.order_status, o.order_priority, o.order_purchase_timestamp,
       CAST(o.payment_value AS DOUBLE) AS payment_value
FROM m_items i LEFT JOIN m_orders o ON i.order_id = o.order_id"""),
    ),
    "master_view": (
        master_view,
        over_mart(f"""
SELECT i.order_id, i.product_id, i.seller_id, {big("i.order_item_id")} AS order_item_id,
       CAST(i.price AS DOUBLE) AS price, CAST(i.freight_value AS DOUBLE) AS freight_value,
       o.customer_id AS orders_customer_id, o.order_status AS orders_order_status,
       o.order_priority AS orders_order_priority,
       o.order_purchase_timestamp AS orders_order_purchase_timestamp,
       CAST(o.payment_value AS DOUBLE) AS orders_payment_value,
       p.product_category_name AS products_product_category_name
FROM m_items i LEFT JOIN m_orders o ON i.order_id = o.order_id
     LEFT JOIN m_products p ON i.product_id = p.product_id"""),
    ),
    "master_view_fan_out": (
        master_view_fan_out,
        over_mart("""
SELECT o.order_id, o.customer_id, o.order_status, o.order_priority, o.order_purchase_timestamp,
       CAST(o.payment_value AS DOUBLE) AS payment_value
FROM m_orders o LEFT JOIN m_customers c ON o.customer_id = c.customer_id
     LEFT JOIN m_items i ON o.order_id = i.order_id"""),
    ),
    "view_time_series": (
        view_time_series,
        over_mart(f"""
SELECT date_trunc('month', order_purchase_timestamp) AS period, {big("COUNT(*)")} AS record_count,
       {_MEASURES}, {_RANGE} FROM m_orders WHERE payment_value IS NOT NULL GROUP BY 1"""),
    ),
    "view_by_category": (
        view_by_category,
        over_mart(f"""
SELECT order_status AS category, {big("COUNT(*)")} AS record_count, {_MEASURES},
       {rnd("CAST(SUM(payment_value) AS DOUBLE) * 100 / NULLIF(CAST(SUM(SUM(payment_value)) OVER () AS DOUBLE), 0)")}
         AS value_share_pct FROM m_orders GROUP BY 1"""),
    ),
    "view_entity_summary": (
        view_entity_summary,
        over_mart(f"""
SELECT customer_id AS entity_id, {big("COUNT(*)")} AS transaction_count, {_MEASURES}, {_RANGE}
FROM m_orders GROUP BY 1"""),
    ),
    "view_summary": (
        view_summary,
        over_mart(
            "SELECT " + big("COUNT(*)") + " AS total_rows, "
            + ", ".join(f"{big(f'COUNT({c})')} AS {c}_count" for c in ITEM_TYPES) + " FROM m_items"
        ),
    ),
}
