import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewise.functions import columns as c
from tablewise.functions import names, rules


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()[0]


def many(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_title_case_equals_python(spark):
    words = ["日本abc", "ß1x", "o'neil 3RD", "new-york", "NORTH", "émile zola", "", "a1b2", "x  y", "3rd street"]
    assert many(spark, words, c.title_case) == [w.title() for w in words]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ'- 019\t", max_size=12), min_size=1, max_size=30))
def test_title_and_strip_property(spark, words):
    assert many(spark, words, c.title_case) == [w.title() for w in words]
    assert many(spark, words, c.strip_blanks) == [w.strip() for w in words]


def test_numbers(spark):
    texts = ["5d", " 12.5 ", "1e3", "-.5", "1.", "abc", "", None, "1,000", "+7"]
    assert many(spark, texts, c.to_number) == [None, 12.5, 1000.0, -0.5, 1.0, None, None, None, None, 7.0]


def test_null_tokens(spark):
    assert many(spark, [" N/A ", "Unknown", "x", None, "--"], c.drop_null_tokens) == [None, None, "x", None, None]


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("2024-01-15", dt.datetime(2024, 1, 15)),
        ("2024-01-15 10:30:00", dt.datetime(2024, 1, 15, 10, 30)),
        ("2024-01-15T10:30:00Z", dt.datetime(2024, 1, 15, 10, 30)),
        ("2024/01/15", dt.datetime(2024, 1, 15)),
        ("1/5/2024", dt.datetime(2024, 1, 5)),
        ("13/03/2025", dt.datetime(2025, 3, 13)),
        ("12/05/2023 14:05", dt.datetime(2023, 12, 5, 14, 5)),
        ("1/5/2024 2:07 pm", dt.datetime(2024, 1, 5, 14, 7)),
        ("01-15-2024", dt.datetime(2024, 1, 15)),
        ("Jan 15, 2024", dt.datetime(2024, 1, 15)),
        ("15 January 2024", dt.datetime(2024, 1, 15)),
        ("20240115", dt.datetime(2024, 1, 15)),
        ("unknown", None),
        ("5.0", None),
        ("31/31/2024", None),
    ],
)
def test_moments(spark, text, moment):
    assert one(spark, text, c.to_moment) == moment


def test_flags(spark):
    assert many(spark, ["Yes", " n ", "TRUE", "0", "maybe"], c.to_flag) == [True, False, True, False, None]


def test_percent_change(spark):
    df = spark.createDataFrame([(150.0, 120.0), (80.0, 100.0), (100.0, 0.0), (-15.0, -10.0)], "a double, b double")
    assert [r[0] for r in df.select(c.percent_change(F.col("a"), F.col("b"))).collect()] == [25.0, -20.0, None, -50.0]


def test_whole_days_cut_towards_zero(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-04 23:00:00' AS b")
    assert df.select(c.whole_days(F.col("a"), F.col("b")), c.whole_days(F.col("b"), F.col("a"))).first()[:] == (-3, 3)


def test_paths_and_buckets(spark):
    uuid_path = "/api/status/123e4567-e89b-12d3-a456-426614174000"
    assert many(spark, [uuid_path, "/api/schema/42"], c.templated_path) == ["/api/status/:id", "/api/schema/:id"]
    assert many(spark, [0.1, 0.5, 2.0, 2.5], c.duration_bucket, "double") == ["le_0_5", "le_0_5", "le_2", "gt_2"]


def test_display(spark):
    df = spark.createDataFrame([(1234.5, "currency"), (1234.0, "count"), (33.333, "percent"), (232.0, "days")], "v double, u string")
    shown = [r[0] for r in df.select(c.display_value(F.col("v"), F.col("u"))).collect()]
    assert shown == ["$1,234.50", "1,234", "33.3%", "232 days"]
    assert many(spark, [1.5e9, 2.5e6, 45500.0, 12.0], c.compact_value, "double") == ["1.5B", "2.5M", "45.5K", "12.00"]
    assert many(spark, [None, 2048, 3 * 1024 * 1024], c.file_size_text, "long") == ["-", "2.0 KB", "3.0 MB"]


def test_compact_values_of_a_trillion_have_no_separator(spark):
    assert many(spark, [2.2514e12, -1.5e12], c.compact_value, "double") == ["2251.4B", "-1500.0B"]


def test_table_names():
    session = "a3f2c1d4-9b8e-4f2a-b1c3-d4e5f6a7b8c9"
    assert names.table_name(session, "Sales Data 2024.csv") == "a3f2c1d4_sales_data_2024"
    assert names.table_name(session, "été--x..y.csv") == "a3f2c1d4_t_x_y"
    assert names.table_name(session, "###.csv") == "a3f2c1d4_table"


def test_key_names():
    assert names.key_stem("CUSTOMER_ID") == "customer"
    assert names.same_key("cust", "customer")
    assert names.same_key("user", "user_account")
    assert not names.same_key("or", "order") and not names.same_key("order", "invoice")
    assert not names.same_key("", "order")
    assert names.join_view_name("a3f2c1d4_orders", "a3f2c1d4_customers") == "view_a3f2c1d4_orders_customers"
    assert names.join_view_name("orders", "customers") == "view_orders_customers"


def test_labels_and_hints():
    assert names.label("product_category_name") == "Product Category Name"
    assert names.label("customer_id") == "Customer"
    assert names.best_hit(["ship_date", "order_purchase"], ("purchase", "date")) == "order_purchase"
    assert names.best_hit(["a", "b"], ("x",)) == "a"
    assert names.has_keyword("update_flag", rules.DATE_WORDS)
    assert not names.has_keyword("update_flag", rules.DATE_WORDS, "token")
