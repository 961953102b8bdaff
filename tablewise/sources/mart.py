"""Order-mart view of the star schema: orders, order items, products and customers.

Keys stay the integers of the source tables (cheap to hash, shuffle and join); ``text_ids``
turns them into prefixed strings for the type rules, which read only text as foreign keys.
Amounts are exact decimals, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.sources.tables import read_table

STATUS_NAMES = {"F": "Delivered", "O": "Shipped", "P": "Processing"}


def _status(code: Column) -> Column:
    named = F.when(code == "F", F.lit(STATUS_NAMES["F"])).when(code == "O", F.lit(STATUS_NAMES["O"]))
    return named.when(code == "P", F.lit(STATUS_NAMES["P"])).otherwise(code)


@dataclass(frozen=True)
class Mart:
    spark: SparkSession
    folder: str
    text_ids: bool = False

    def _key(self, column: str, prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column).cast("string")) if self.text_ids else F.col(column)

    @cached_property
    def orders(self) -> DataFrame:
        return read_table(self.spark, self.folder, "orders").select(
            self._key("o_orderkey", "O").alias("order_id"),
            self._key("o_custkey", "C").alias("customer_id"),
            _status(F.col("o_orderstatus")).alias("order_status"),
            F.col("o_orderpriority").alias("order_priority"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("payment_value"),
        )

    @cached_property
    def items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        tax = F.col("l_tax").cast("decimal(4,2)")
        return read_table(self.spark, self.folder, "lineitem").select(
            self._key("l_orderkey", "O").alias("order_id"),
            self._key("l_partkey", "P").alias("product_id"),
            self._key("l_suppkey", "S").alias("seller_id"),
            F.col("l_linenumber").alias("order_item_id"),
            price.alias("price"),
            F.round(price * tax, 2).cast("decimal(18,2)").alias("freight_value"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return read_table(self.spark, self.folder, "part").select(
            self._key("p_partkey", "P").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation = read_table(self.spark, self.folder, "nation")
        customer = read_table(self.spark, self.folder, "customer")
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner").select(
            self._key("c_custkey", "C").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """Orders with their delivery dates: the last shipment of a delivered order, and an
        estimate 30 days after purchase."""
        shipped = read_table(self.spark, self.folder, "lineitem").groupBy(
            self._key("l_orderkey", "O").alias("order_id")
        ).agg(F.max("l_shipdate").alias("last_shipment"))
        return self.orders.join(shipped, "order_id", "left").select(
            "order_id",
            "order_status",
            "order_purchase_timestamp",
            F.when(F.col("order_status") == STATUS_NAMES["F"], F.col("last_shipment")).alias(
                "order_delivered_customer_date"
            ),
            (F.col("order_purchase_timestamp") + F.expr("INTERVAL 30 DAYS")).alias(
                "order_estimated_delivery_date"
            ),
        )
