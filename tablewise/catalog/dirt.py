"""Orders as a careless export would write them: every order, all columns text.

The same SELECT builds the input in Spark and for the SQL check. It keeps every row of
``orders``; the key only decides which kind of dirt a row gets, and some rows are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewise.sources.tables import read_table

_DAY = "CAST(o_orderdate AS STRING)"

DIRTY_ORDERS = f"""
SELECT CASE WHEN o_orderkey % 97 = 5 THEN 'N/A' WHEN o_orderkey % 97 = 11 THEN NULL
            ELSE 'O' || CAST(o_orderkey AS STRING) END AS order_id,
       'C' || CAST(o_custkey AS STRING) AS customer_id,
       CASE WHEN o_orderkey % 53 = 3 THEN 'unknown'
            WHEN o_orderkey % 4 = 1
              THEN substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 1, 4)
            WHEN o_orderkey % 4 = 2 AND CAST(substr({_DAY}, 9, 2) AS INT) > 12
              THEN substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 1, 4)
            WHEN o_orderkey % 4 = 3 THEN substr({_DAY}, 1, 10)
            ELSE substr({_DAY}, 1, 19) END AS order_date,
       CASE WHEN o_orderkey % 131 = 0 THEN '--' WHEN o_orderkey % 131 = 1 THEN 'null'
            WHEN o_orderkey % 131 = 3 THEN '5d'
            WHEN o_orderkey % 131 = 2
              THEN ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || ' '
            WHEN o_orderkey % 1009 = 7
              THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS STRING)
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS unit_price,
       CASE WHEN o_orderkey % 41 = 0 THEN '?' WHEN o_orderkey % 43 = 0 THEN NULL
            ELSE CAST(o_orderkey % 17 + 1 AS STRING) END AS quantity,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 13 = 1 THEN 'o' || chr(39) || 'neil 3RD'
            WHEN o_orderkey % 13 = 2 THEN 'new-york'
            WHEN o_orderkey % 13 = 3 THEN chr(9) || 'NORTH '
            WHEN o_orderkey % 13 = 4 THEN 'north'
            WHEN o_orderstatus = 'F' THEN 'South' WHEN o_orderstatus = 'O' THEN 'north' ELSE 'EAST'
            END AS region,
       CAST(NULL AS STRING) AS note,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 < 4 THEN 'yes' ELSE 'No' END
         AS is_gift
FROM {{orders}}"""

WITH_REPEATS = """
SELECT * FROM {dirty}
UNION ALL
SELECT * FROM {dirty} WHERE quantity = '9'
UNION ALL
SELECT order_id, customer_id, order_date, unit_price, quantity, region || ' ' AS region, note, is_gift
FROM {dirty} WHERE quantity = '11'"""

COLUMNS = ("order_id", "customer_id", "order_date", "unit_price", "quantity", "region", "note", "is_gift")

DIRTY_SQL = (
    "dirty_once AS (" + DIRTY_ORDERS.format(orders="orders") + "),\n"
    "dirty AS (" + WITH_REPEATS.format(dirty="dirty_once") + ")"
)


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    once = spark.sql(DIRTY_ORDERS, orders=orders)
    return spark.sql(WITH_REPEATS, dirty=once)
