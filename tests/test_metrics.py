import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewise.operators import compare, kpi
from tablewise.operators.filters import DashboardFilters, apply_filters, apply_preset

ORDERS = {"order_id": "id", "customer_id": "id", "revenue": "currency"}


@pytest.fixture(scope="module")
def orders(spark):
    rows = [("o1", "c1", 100.0), ("o1", "c1", 20.0), ("o2", "c2", 80.0), ("o3", "c2", -10.0)]
    return spark.createDataFrame(rows, "order_id string, customer_id string, revenue double")


def values(frame):
    return {r["kpi_name"]: r["kpi_value"] for r in frame.collect()}


def test_metric_values(orders):
    got = values(kpi.calculate_metrics({"orders": orders}, {"orders": ORDERS}))
    assert got["Total Revenue"] == 190.0
    assert got["Avg Order Value"] == pytest.approx(190 / 3)
    assert (got["Total Orders"], got["Total Customers"], got["Max Transaction"]) == (3.0, 2.0, 100.0)
    assert got["Revenue per Customer"] == 95.0


def test_revenue_picker():
    assert kpi.pick_revenue(["price"], "products", None) is None
    assert kpi.pick_revenue(["revenue"], "products", None) == "revenue"
    assert kpi.pick_revenue(["amount", "revenue"], "orders", "order_id") == "revenue"
    assert kpi.pick_revenue(["total"], "products", None) is None
    assert kpi.pick_revenue(["total"], "orders", "order_id") == "total"
    assert kpi.pick_revenue([], "orders", None) is None


def test_null_ids_and_rates(spark):
    rows = [("o1", None, " Delivered"), ("o1", "c1", "shipped"), ("o2", "c1", "shipped"), (None, "c2", "delivered")]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, order_status string")
    types = {"order_id": "id", "customer_id": "id", "order_status": "category"}
    got = values(kpi.calculate_metrics({"orders": df}, {"orders": types}))
    assert got == {"Total Orders": 2.0, "Total Customers": 2.0, "Delivery Rate": 50.0}
    by_rows = values(kpi.calculate_metrics({"x": df.select("order_status")}, {"x": {"order_status": "category"}}))
    assert by_rows == {"Delivery Rate": 50.0}


def test_empty_table_counts_nothing(spark, orders):
    got = values(kpi.calculate_metrics({"orders": orders.limit(0)}, {"orders": ORDERS}))
    assert got == {"Total Orders": 0.0, "Total Customers": 0.0}


def test_first_table_wins_and_ten_are_kept(spark):
    wide = spark.createDataFrame(
        [("o1", "c1", "p1", "s1", 5.0, dt.datetime(2024, 1, 1), "a", "delivered"),
         ("o2", "c2", "p2", "s2", 7.0, dt.datetime(2024, 3, 1), "b", "lost")],
        "order_id string, customer_id string, product_id string, seller_id string, revenue double,"
        " created timestamp, product_category string, order_status string",
    )
    types = {
        "order_id": "id", "customer_id": "id", "product_id": "id", "seller_id": "id", "revenue": "currency",
        "created": "datetime", "product_category": "category", "order_status": "category",
    }
    frame = kpi.calculate_metrics({"a": wide, "b": wide.limit(1)}, {"a": types, "b": types}).collect()
    assert len(frame) == 11 and {r["table_name"] for r in frame} == {"a"}
    assert {"Max Transaction", "Data Time Span"} <= {r["kpi_name"] for r in frame}
    assert all(0.5 <= r["confidence"] <= 0.99 for r in frame)
    assert [r["tier"] for r in frame] == sorted(r["tier"] for r in frame)


def test_filters(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 59), "Delivered"), (dt.datetime(2024, 1, 2), "Delivered"), (dt.datetime(2024, 1, 1), "Lost")]
    df = spark.createDataFrame(rows, "Order_Date timestamp, Order_Status string")
    one = DashboardFilters("Order_Date", dt.date(2024, 1, 1), dt.date(2024, 1, 1), "Order_Status", "Delivered")
    assert apply_filters(df, one).count() == 1
    assert apply_filters(df, DashboardFilters("Order_Date")) is df
    assert apply_filters(df, DashboardFilters("missing", dt.date(2024, 1, 1))).count() == 3
    assert not DashboardFilters("Order_Date").active
    with pytest.raises(ValueError):
        DashboardFilters("Order_Date", dt.date(2024, 2, 1), dt.date(2024, 1, 1)).validate()
    with pytest.raises(ValueError):
        DashboardFilters('x"; DROP').validate()
    with pytest.raises(ValueError):
        DashboardFilters(category_column="a", category_value=" ").validate()
    types = {"t": {"Order_Date": "datetime", "Order_Status": "category"}}
    one.validate_against({"t": df}, types)
    for bad in (
        DashboardFilters("Order_Status"), DashboardFilters(category_column="Order_Date"),
        DashboardFilters(date_from=dt.date(2024, 1, 1)), DashboardFilters(category_value="x"),
    ):
        with pytest.raises(ValueError):
            bad.validate_against({"t": df}, types)
    with pytest.raises(ValueError, match="holds none"):
        one.validate_against({"t": df.limit(0)}, types)
    assert apply_preset(df, "Order_Date", "30d").count() == 3


def test_date_filter_reaches_parquet(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet")
    filters = DashboardFilters("o_orderdate", dt.date(1998, 1, 1), dt.date(1998, 1, 31))
    plan = apply_filters(df, filters)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in plan


def test_previous_period():
    period = DashboardFilters("d", dt.date(2025, 3, 10), dt.date(2025, 3, 19), "c", "v")
    before = period.previous_period()
    assert (before.date_from, before.date_to) == (dt.date(2025, 2, 28), dt.date(2025, 3, 9))
    assert before.category_value == "v"
    day = DashboardFilters("d", dt.date(2025, 3, 10), dt.date(2025, 3, 10)).previous_period()
    assert day.date_from == day.date_to == dt.date(2025, 3, 9)
    assert DashboardFilters("d").previous_period() is None


def window(spark, *days):
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp").alias("order_date"))
    return compare.monitoring_window({"orders": df}, {"orders": {"order_date": "datetime"}})


def test_monitoring_window(spark):
    assert window(spark, "2025-01-01", "2025-03-01") == ("order_date", dt.date(2025, 1, 31), dt.date(2025, 3, 1))
    assert window(spark, "2025-01-01", "2025-02-28") is None
    assert compare.monitoring_window({"a": spark.range(1)}, {"a": {"id": "id"}}) is None


def test_compare_periods_in_one_scan(spark):
    rows = [("o1", 10.0, "2024-02-01"), ("o2", 30.0, "2024-02-02"), ("o3", 20.0, "2024-01-30"), ("o4", 99.0, "2023-01-01")]
    df = spark.createDataFrame(rows, "order_id string, revenue double, d string").withColumn("d", F.col("d").cast("timestamp"))
    types = {"orders": {"order_id": "id", "revenue": "currency", "d": "datetime"}}
    period = DashboardFilters("d", dt.date(2024, 2, 1), dt.date(2024, 2, 3))
    got = {r["kpi_name"]: r for r in compare.compare_periods({"orders": df}, types, period).collect()}
    assert (got["Total Revenue"]["current_value"], got["Total Revenue"]["previous_value"]) == (40.0, 20.0)
    assert (got["Total Orders"]["percent_change"], got["Total Orders"]["direction"]) == (100.0, "up")
    assert compare.compare_periods({"orders": df}, types, DashboardFilters("d")).count() == 0


def comparison(spark, *rows):
    full = []
    for name, current, previous in rows:
        change = current - previous
        full.append(
            (name, float(current), float(previous), float(change), change / abs(previous) * 100 if previous else None,
             "up" if change > 0 else "down" if change < 0 else "flat")
        )
    return spark.createDataFrame(full, compare.COMPARISON_SCHEMA)


def alerts(spark, *rows):
    frame = compare.alerts_with_related(comparison(spark, *rows), "2025-01-01", "2025-01-30")
    return {r["kpi_name"]: r for r in frame.collect()}


def test_alert_severity(spark):
    assert alerts(spark, ("Total Revenue", 68.6, 100))["Total Revenue"]["severity"] == "medium"
    assert alerts(spark, ("Total Revenue", 78, 100))["Total Revenue"]["severity"] == "low"
    assert alerts(spark, ("Total Orders", 40, 100))["Total Orders"]["severity"] == "high"
    rate = alerts(spark, ("Delivery Rate", 75, 90))["Delivery Rate"]
    assert "15.0 percentage points" in rate["message"] and rate["severity"] == "medium"
    assert alerts(spark, ("Total Revenue", 110, 100), ("Total Orders", 10, 0)) == {}


def test_related_alerts(spark):
    got = alerts(spark, ("Total Revenue", 68, 100), ("Total Orders", 70, 100), ("Total Customers", 60, 100))
    assert [m["kpi_name"] for m in got["Total Revenue"]["related_movements"]] == ["Total Orders"]
    assert got["Total Revenue"]["title"] == "Total Revenue decreased 32.0%"
    assert got["Total Revenue"]["message"].endswith("from 100.00 to 68.00 between 2025-01-01 and 2025-01-30, against the period before.")
    kinds = spark.createDataFrame([("business_alert_high",), ("anomaly_detected",), ("x",)], "e string")
    assert [r[0] for r in kinds.select(compare.severity_of(F.col("e"))).collect()] == ["high", "medium", "low"]


def metrics(spark):
    rows = [("Total Revenue", 1000.0, 0.8, 1), ("Total Orders", 50.0, 0.8, 2)]
    return spark.createDataFrame(rows, "kpi_name string, kpi_value double, confidence double, rank int")


def test_what_if(spark):
    out = compare.what_if(metrics(spark), {"s": {"revenue": 0.2, "Total Orders": -0.1}})
    got = {r["kpi_name"]: r for r in out.collect()}
    assert (got["Total Revenue"]["projected_value"], got["Total Orders"]["projected_value"]) == (1200.0, 45.0)
    assert got["Total Revenue"]["delta_pct"] == 20.0
    assert compare.scenario_summaries(out).first()["summary"].startswith("Revenue: a rise of 20.0%")
    calm = compare.scenario_summaries(compare.what_if(metrics(spark), {"none": {}}))
    assert calm.first()["summary"].startswith("This scenario moves no")


@pytest.mark.parametrize(("unit", "change", "expected"), [("auto", 1.0, 2000.0), ("auto", 1.5, 1015.0), ("percent", 1.0, 1010.0), ("fraction", 1.5, 2500.0)])
def test_what_if_units(spark, unit, change, expected):
    out = compare.what_if(metrics(spark), {"s": {"total_revenue": change}}, unit)
    assert out.filter("kpi_name = 'Total Revenue'").first()["projected_value"] == expected
