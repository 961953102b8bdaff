import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewise.catalog import sessions
from tablewise.operators import insights
from tablewise.operators.filters import DashboardFilters
from tablewise.plans import report, run, sqlaccess
from tablewise.sources.metadata import SCHEMAS, MetadataStore, latest_sessions, unseen


@pytest.fixture(scope="module")
def upload(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("upload")
    start = dt.date(2024, 1, 1)
    statuses = ["delivered", "SHIPPED", "Delivered "]
    orders = ["order_id,customer_id,order_date,order_status,payment_value"]
    for i in range(150):
        price = 1000 if i == 149 else 20 + i % 9
        orders.append(f"o{i},c{i % 30},{start + dt.timedelta(days=i // 2)},{statuses[i % 3]},{price}.25")
    orders += [orders[1], "N/A,c1,2024-01-05,shipped,10.00"]
    customers = ["customer_id,customer_state"] + [f"c{i},{'north' if i % 2 else 'South'}" for i in range(30)]
    (root / "Orders 2024.csv").write_text("\n".join(orders) + "\n")
    (root / "customers.csv").write_text("\n".join(customers) + "\n")
    (root / "notes.txt").write_text("x")
    store = MetadataStore(spark, str(root / "meta")).create()
    paths = [str(root / n) for n in ("Orders 2024.csv", "customers.csv", "notes.txt")]
    done = run.run_session(spark, store, paths, session_id="feedbeef-0000-0000-0000-000000000000")
    return store, done


def test_run(spark, upload):
    store, done = upload
    assert done.status == "done" and not done.errors
    assert done.warnings == ["'notes.txt' is of no known kind and is left out"]
    assert done.row_counts == {"feedbeef_orders_2024": 150, "feedbeef_customers": 30}
    (link,) = done.relationships
    assert (link.from_table, link.to_table, link.match_percent) == ("feedbeef_orders_2024", "feedbeef_customers", 100.0)
    status = store.status(done.session_id).first()
    assert (status["status"], status["total_files"], status["total_rows"]) == ("done", 2, 180)
    stored = {r["kpi_name"]: r for r in store.read("kpi_results", done.session_id).collect()}
    assert stored["Total Orders"]["kpi_value"] == 150.0 and stored["Delivery Rate"]["kpi_value"] == 66.7
    assert stored["Total Orders"]["confidence"] == 0.8
    assert {r["order_status"] for r in spark.table("feedbeef_orders_2024").collect()} == {"Delivered", "Shipped"}
    quality = {r["table_name"]: r for r in store.read("quality_reports", done.session_id).collect()}
    assert quality["feedbeef_orders_2024"]["duplicate_rows"] == 1
    files = {r["original_filename"]: r["encoding"] for r in store.read("uploaded_files").collect()}
    assert files == {"Orders 2024.csv": "UTF-8", "customers.csv": "UTF-8"}
    assert store.insight_history(done.session_id).count() > 0
    assert "view_feedbeef_orders_2024_customers" in done.views
    notices = [r["message"] for r in store.notifications(done.session_id).collect()]
    assert any("feedbeef_orders_2024 (1 column(s))" in m for m in notices)


def test_rerunning_analytics_replaces_the_snapshot(upload):
    store, done = upload
    before = store.read("kpi_results", done.session_id).count()
    run.run_analytics(done, store)
    assert store.read("kpi_results", done.session_id).count() == before
    store.replace("kpi_results", store.read("kpi_results").limit(0), "another")
    assert store.read("kpi_results", done.session_id).count() == before and store.read("kpi_results", "another").count() == 0


def test_alerts_are_notified_once(upload):
    store, done = upload
    filters = DashboardFilters("order_date", dt.date(2024, 3, 10), dt.date(2024, 3, 15))
    first = run.evaluate_alerts(done, store, filters)
    assert first.count() > 0
    count = store.read("notifications", done.session_id).count()
    run.evaluate_alerts(done, store, filters)
    assert store.read("notifications", done.session_id).count() == count
    history = run.alert_history(store, done.session_id).collect()
    assert history and {r["severity"] for r in history} <= {"low", "medium", "high"}
    assert not any(r["read"] for r in store.notifications(done.session_id).collect())
    store.mark_read(done.session_id)
    assert all(r["read"] for r in store.notifications(done.session_id).collect())


def test_notices_of_a_session_stay_off_the_driver(spark, folder, monkeypatch):
    def collect(df):
        raise AssertionError("rows on the driver")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "collect", collect)
        notices = sessions.notification_list(spark, folder)
    rows = notices.collect()
    half = len(rows) // 2
    assert half and [r["at"] for r in rows] == ["before"] * half + ["after"] * half
    assert [r["read"] for r in rows] == [False] * half + [True] * half
    assert [r["title"] for r in rows[:half]] == [r["title"] for r in rows[half:]]


def test_report(upload):
    store, done = upload
    sections = report.report_tables(store, done.session_id, done.tables, done.types, done.charts)
    assert sections["scope"].first()["scope"] == "Status: done | Rows: 180 | no filter."
    assert sections["files"].count() == 2 and sections["kpis"].count() > 3
    assert all(frame.count() <= 12 for name, frame in sections.items() if name.startswith("chart"))
    filters = DashboardFilters("order_date", dt.date(2024, 1, 1), None, "order_status", "Delivered")
    scoped = report.report_tables(store, done.session_id, done.tables, done.types, [], filters)
    assert "from 2024-01-01 until the last | only Delivered" in scoped["scope"].first()["scope"]


def test_public_dashboard(upload):
    store, done = upload
    tables = [store.read(t) for t in ("kpi_results", "insights", "chart_configs")]
    shown = insights.public_subset(*tables, done.session_id)
    assert shown["kpis"].count() > 3 and shown["insights"].count() <= 5
    assert {r["chart_type"] for r in shown["charts"].collect()} <= set(insights.PUBLIC_CHARTS)


def test_chart_frames(upload):
    _, done = upload
    frames = run.chart_frames(done)
    assert frames and all(f.count() > 0 for f in frames.values())


def test_sessions_and_names(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path)).create()
    assert store.session_list().count() == 0
    store.set_status("12345678", "loading", total_files=3, total_rows=50)
    store.set_status("12345678", "done")
    store.set_status("00001234-5", "error", error_message="broken")
    row = {r["session_id"]: r for r in store.session_list().collect()}
    assert (row["12345678"]["status"], row["12345678"]["total_files"], row["12345678"]["name"]) == ("done", 3, "Dataset 12345678")
    assert row["00001234-5"]["status"] == "error"
    store.rename("12345678", " Sales ")
    renamed = store.status("12345678").first()
    assert (renamed["session_name"], renamed["status"], renamed["total_rows"]) == ("Sales", "done", 50)
    with pytest.raises(ValueError):
        store.rename("12345678", "  ")


def test_failures(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path)).create()
    with pytest.raises(ValueError, match="none of the files"):
        run.run_session(spark, store, [str(tmp_path / "x.txt")], session_id="dead0000")
    assert store.status("dead0000").first()["error_message"] == "none of the files can be loaded"


def test_unseen(spark):
    keys = "session_id string, event_type string, title string, message string"
    new = spark.createDataFrame([("s", "a", "t", "m1"), ("s", "a", "t", "m1"), ("s", "a", "t", "m2")], keys)
    old = spark.createDataFrame([("s", "a", "t", "m2"), ("s", "a", "t", "m3")], keys)
    assert [r["message"] for r in unseen(new, old).collect()] == ["m1"]


def test_latest_sessions_keep_counts(spark):
    events = spark.createDataFrame(
        [("s", 1, 1, "loading", 4, 9, None), ("s", 2, 2, "done", 0, 0, None), ("s", 3, 3, None, 0, 0, "N")],
        "session_id string, event_at long, event_no long, status string, total_files long, total_rows long, session_name string",
    ).withColumns({"error_message": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("timestamp")})
    r = latest_sessions(events).first()
    assert (r["status"], r["total_files"], r["total_rows"], r["session_name"], r["created_at"]) == ("done", 4, 9, "N", 1)


@pytest.mark.parametrize(
    "sql", ["DELETE FROM t", "SELECT 1; DELETE FROM t", "", None, "SELECT 1 -- x", "WITH a AS (SELECT 1) SELECT 1", "SELECT 1; SELECT 2"]
)
def test_guard_rejects(sql):
    with pytest.raises(ValueError):
        sqlaccess.read_only(sql)


def test_guard_passes_and_runs(spark):
    spark.range(100).createOrReplaceTempView("5eed0042_numbers")
    assert sqlaccess.read_only(" select id from t where id > 1 limit 5; ") == "select id from t where id > 1 limit 5"
    assert sqlaccess.run_query(spark, "SELECT id FROM 5eed0042_numbers").count() == 100
    assert sqlaccess.run_query(spark, "SELECT id FROM 5eed0042_numbers", rows=50).count() == 50
    context = sqlaccess.schema_context(spark, "5eed0042").collect()
    assert [(r["object_name"], r["column_name"], r["data_type"]) for r in context] == [("5eed0042_numbers", "id", "bigint")]


def test_compaction_keeps_every_state_and_bounds_what_is_read(spark, tmp_path):
    rng = random.Random(3)
    plain, store = (MetadataStore(spark, str(tmp_path / n)).create() for n in ("plain", "compacted"))
    start, number = dt.datetime(2024, 1, 1), 0
    for day in range(5):
        rows = []
        for _ in range(60):
            number += 1
            rows.append((
                f"s{rng.randrange(8)}", start + dt.timedelta(minutes=number), number, rng.choice(["loading", "done", "error", None]),
                rng.choice([0, 3, 7]), rng.choice([0, 100]), None, None, rng.choice([None, None, f"name {number}"]),
            ))
        events = spark.createDataFrame(rows, SCHEMAS["status_events"])
        for s in (plain, store):
            s.append("status_events", events)
        store.compact()
        assert sorted(map(str, store.sessions().collect())) == sorted(map(str, plain.sessions().collect()))
    # an event that a slow writer adds to the generation before the open one still counts
    late = spark.createDataFrame([("s1", start + dt.timedelta(days=9), 10**6, "slow", 1, 1, None, None, None)], SCHEMAS["status_events"])
    late.write.mode("append").partitionBy("session_id").parquet(store._generation(4))
    assert {r["session_id"]: r["status"] for r in store.sessions().collect()}["s1"] == "slow"
    store.compact()
    assert {r["session_id"]: r["status"] for r in store.sessions().collect()}["s1"] == "slow"
    store.compact()
    log = store._status_log()
    assert log.count() <= 5 * 8 and len(plain._status_log().inputFiles()) > len(log.inputFiles())
    assert store._manifest() == (7, 6)
    store.set_status("s2", "renewed")
    assert store.status("s2").first()["status"] == "renewed"
