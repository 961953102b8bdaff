"""Catalogue: ingestion, session metadata, request log and read-only SQL."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tablewise.catalog.common import big, plain
from tablewise.catalog.dirt import COLUMNS, DIRTY_SQL, dirty_orders
from tablewise.functions import names, rules
from tablewise.operators import charts, insights
from tablewise.plans import report, run, sqlaccess
from tablewise.session import configure, stage, work_folder
from tablewise.sources import archives, files
from tablewise.sources.mart import Mart
from tablewise.sources.metadata import MetadataStore, latest_sessions, session_list, unseen
from tablewise.sources.tables import read_table
from tablewise.streaming.jobs import request_rollup


def csv_ingest(spark, folder):
    """The dirty orders written as CSV and read back."""
    path = work_folder(spark, "csv")
    dirty_orders(spark, folder).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return files.read_csv(spark, path)


def encoding_probe(spark, folder):
    """Texts written once as they are and once as Latin-1, then probed."""
    root = work_folder(spark, "encodings")
    words = read_table(spark, folder, "part").select(F.concat("p_name", F.lit(" Größe"), F.col("p_size")))
    words.write.text(f"{root}/utf")
    words.write.option("encoding", "ISO-8859-1").csv(f"{root}/latin")
    probed = files.probe_encodings(spark, [f"{root}/utf", f"{root}/latin"])
    kind = F.regexp_extract("path", "/(utf|latin)/", 1)
    return probed.select(kind.alias("kind"), "encoding").distinct()


def zip_ingest(spark, folder):
    """Orders packed as CSV members of one archive per batch, then read from the archives."""
    schema = "path string, content binary"

    def pack(batches):
        for i, batch in enumerate(batches):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
                out.writestr("data/orders.csv", batch.to_csv(index=False))
                out.writestr("__MACOSX/orders.csv", "skipped")
                out.writestr("notes.txt", "skipped")
            yield pd.DataFrame({"path": [f"batch-{i}.zip"], "content": [raw.getvalue()]})

    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = archives.unzip_rows(orders.mapInPandas(pack, schema))
    table = archives.member_table(rows, "data/orders.csv", orders.columns)
    return table.select(
        F.col("o_orderkey").cast("long"), "o_orderstatus", F.col("o_totalprice").cast("double")
    )


def _table_names(rows, key: str):
    """``key`` and the table that a file of each name would become; the rule runs where the rows lie."""

    def work(batches):
        for batch in batches:
            found = [names.table_name("a3f2c1d4-0000", name or "") for name in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "table_name"])

    return rows.toDF(key, "name").mapInArrow(work, f"{key} long, table_name string")


def table_names(spark, folder):
    """File names derived from page addresses, as the table names they would get."""
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return _table_names(read_table(spark, folder, "pages").select(F.col("page_id").cast("long"), name), "page_id")


def exact_amounts(spark, folder):
    """Sums of very small and very large amounts."""
    odd = F.col("o_orderkey") % 2 == 1
    rows = read_table(spark, folder, "orders").select(
        F.when(odd, "small").otherwise("large").alias("size"), F.when(odd, 0.00001).otherwise(1e15).alias("amount")
    )
    return charts.top_groups(rows, "size", "amount")


def multi_file_load(spark, folder):
    """Files of one name in two folders: one table each, all rows kept."""
    root = work_folder(spark, "load")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    paths = [f"{root}/{year}/orders.csv" for year in ("2023", "2024")]
    for path, rows in zip(paths, (orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"))):
        rows.write.csv(path, header=True)
    tables, _, _ = files.read_tables(spark, paths, "a3f2c1d4-0000")
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey").cast("long")).alias("keys")).select(
            F.lit(name).alias("table_name"), "rows", "keys"
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def archive_load(spark, folder):
    """Orders in two archives that tasks pack, loaded as a session loads them: a member of one name in either is a table."""
    root = work_folder(spark, "archives")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    which = F.when(F.col("o_orderkey") % 3 == 0, "batch-0").otherwise("batch-1")
    paths = archives.pack(orders, which, "orders.csv", root)
    tables, _, _ = files.read_tables(spark, paths, "a3f2c1d4-0000")
    frames = [df.select(F.lit(name).alias("table_name"), *df.columns) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), frames).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


def skipped_csv_rows(spark, folder):
    """Events as a careless tool writes them, with bare commas in every seventh: the rows that a load keeps, and how many it
    leaves out and counts."""
    path = work_folder(spark, "careless")
    note = F.when(F.col("event_id") % 7 == 0, "a,b").when(F.col("event_id") % 5 == 0, '"c,d"').otherwise("e")
    lines = read_table(spark, folder, "events").select(F.concat_ws(",", F.col("event_id").cast("string"), note, "event_type").alias("value"))

    def with_header(batches):
        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array(["event_id,note,event_type"])], schema=batch.schema)
            yield batch

    lines.mapInArrow(with_header, "value string").write.text(path)
    kept = files.read_csv(spark, path, multi_line=False).groupBy("note").agg(F.count(F.lit(1)).alias("rows"))
    skipped = files.skipped_rows(spark, path, multi_line=False).select(F.lit(None).cast("string").alias("note"), F.col("skipped").alias("rows"))
    return kept.unionByName(skipped)


def file_table_names(spark, folder):
    """The table a file named after each nation would become."""
    name = F.concat("n_name", F.lit(" - "), "n_nationkey", F.lit(".v2.csv"))
    return _table_names(read_table(spark, folder, "nation").select(F.col("n_nationkey").cast("long"), name), "n_nationkey")


_EVENT_STATUS = """
status_events AS (
  SELECT 'u' || user_id AS session_id, ts AS event_at, event_id AS event_no, event_type AS status,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS total_files,
         CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 1000 END AS total_rows
  FROM events),
files AS (
  SELECT 'u' || (o_custkey % 200) AS session_id, 'f' || o_orderkey || '.csv' AS original_filename,
         o_orderkey % 500 AS row_count, o_orderdate AS uploaded_at FROM orders)"""


def _status_events(spark, folder):
    no = F.col("event_id")
    return read_table(spark, folder, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("ts").alias("event_at"), no.alias("event_no"),
        F.col("event_type").alias("status"),
        F.when(no % 3 == 0, 0).otherwise(no % 7).alias("total_files"),
        F.when(no % 5 == 0, 0).otherwise(no % 1000).alias("total_rows"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(None).cast("string").alias("session_name"),
    )


def _files(spark, folder):
    return read_table(spark, folder, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey") % 200).alias("session_id"),
        F.concat(F.lit("f"), "o_orderkey", F.lit(".csv")).alias("original_filename"),
        (F.col("o_orderkey") % 500).alias("row_count"), F.col("o_orderdate").alias("uploaded_at"),
    )


def session_latest_status(spark, folder):
    latest = latest_sessions(_status_events(spark, folder))
    return plain(latest.select("session_id", "status", "total_files", "total_rows", "created_at"))


def session_overview(spark, folder):
    return plain(session_list(latest_sessions(_status_events(spark, folder)), _files(spark, folder)))


def _notices(df, day_test):
    return df.filter(day_test).select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), "event_type",
        F.concat(F.lit("Saw "), "event_type").alias("title"), F.get_json_object("props", "$.k").alias("message"),
    )


def notify_once(spark, folder):
    """Notices of the second half of the month that the first half has not given yet."""
    events = read_table(spark, folder, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return unseen(_notices(events, ~early), _notices(events, early))


def _five(column="user_id"):
    return F.concat(F.lit("s"), F.col(column) % 5).alias("session_id")


def _notice_store(spark, folder):
    """A store that holds a notice for every event of the second half of the month."""
    store = MetadataStore(spark, work_folder(spark, "notices")).create()
    late = read_table(spark, folder, "events").filter(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("event_id") % 3 + 1).cast("int"))
    store.append(
        "notifications",
        late.select(
            _five(), F.concat(F.lit("business_alert_"), level).alias("event_type"),
            F.concat(F.lit("Event "), "event_id").alias("title"), F.lit("seen").alias("message"),
            F.col("ts").cast("timestamp").alias("created_at"),
        ),
    )
    return store


def session_names(spark, folder):
    """Sessions after one of them has been given a name."""
    store = MetadataStore(spark, work_folder(spark, "names")).create()
    events = _status_events(spark, folder).withColumn("session_id", F.concat(F.lit("s"), F.substring("session_id", 2, 9).cast("long") % 5))
    store.append("status_events", events)
    store.rename("s3", "  Spring sales ")
    return plain(store.sessions().select("session_id", "session_name", "status"))


def notification_list(spark, folder):
    """The notices of a session, newest first, before and after they are marked as read."""
    store = _notice_store(spark, folder)

    def listed(at):
        return store.notifications("s2").select(F.lit(at).alias("at"), "title", "read", "created_at")

    fresh = stage(listed("before"), "notices")  # written before they are marked
    store.mark_read("s2")
    both = fresh.unionByName(listed("after"))
    return both.orderBy(F.desc("at"), F.desc("created_at"), F.desc("title")).drop("created_at")


def alert_history(spark, folder):
    history = run.alert_history(_notice_store(spark, folder), "s1")
    return history.select("title", "event_type", "severity")


def _shown_store(spark, folder):
    store = MetadataStore(spark, work_folder(spark, "shown")).create()
    parts = read_table(spark, folder, "part")
    kinds = F.element_at(F.array(*map(F.lit, ("line", "box", "pie", "scatter"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    store.append("chart_configs", parts.select(_five("p_partkey"), kinds.alias("chart_type"), F.col("p_name").alias("chart_title"), F.col("p_partkey").alias("chart_order")))
    store.append(
        "insights",
        parts.select(
            _five("p_partkey"), F.when(F.col("p_size") > 20, "chart_insight").otherwise("summary").alias("insight_type"),
            F.col("p_partkey").alias("chart_order"), F.col("p_type").alias("insight_text"),
            F.timestamp_seconds(F.col("p_partkey")).alias("generated_at"),
        ),
    )
    return store


def insight_history(spark, folder):
    return plain(_shown_store(spark, folder).insight_history("s1").select("chart_order", "insight_text"))


def public_dashboard(spark, folder):
    """The charts of allowed types and the insights that a shared dashboard shows."""
    store = _shown_store(spark, folder)
    shown = insights.public_subset(store.read("kpi_results"), store.read("insights"), store.read("chart_configs"), "s1")
    charts_ = shown["charts"].select(F.lit("chart").alias("kind"), F.col("chart_order").alias("place"), F.col("chart_title").alias("text"))
    texts = shown["insights"].select(F.lit("insight").alias("kind"), F.col("chart_order").alias("place"), F.col("insight_text").alias("text"))
    return plain(charts_.unionByName(texts))


def requests(events):
    """Events read as a request log."""
    return events.select(
        "ts", "event_id", F.upper("event_type").alias("method"),
        F.concat(F.lit("/api/user/"), "user_id", F.lit("/item/"), F.get_json_object("props", "$.k")).alias("path"),
        (F.when(F.col("event_type") == "error", 500).otherwise(200) + F.col("event_id") % 5).alias("status"),
        (F.col("value") / 10).alias("seconds"),
    )


def event_log_rollup(spark, folder):
    return plain(request_rollup(requests(read_table(spark, folder, "events"))))


def read_only_sql(spark, folder):
    Mart(spark, folder).orders.createOrReplaceTempView("q_orders")
    return plain(
        sqlaccess.run_query(
            spark,
            "SELECT order_status, COUNT(*) AS orders, SUM(payment_value) AS paid FROM q_orders"
            " GROUP BY order_status ORDER BY order_status;",
        )
    )


def _session(spark, folder):
    configure(spark)
    mart = Mart(spark, folder, text_ids=True)
    store = MetadataStore(spark, work_folder(spark, "metadata")).create()
    tables = {
        "a3f2c1d4_items": mart.items, "a3f2c1d4_orders": mart.orders, "a3f2c1d4_products": mart.products,
        "a3f2c1d4_customers": mart.customers,
    }
    done = run.run_session(spark, store, tables=tables, session_id="a3f2c1d4-0000-0000-0000-000000000000")
    return store, done


def session_run(spark, folder):
    """All stages over the mart; the stored metrics are the result."""
    store, done = _session(spark, folder)
    return store.read("kpi_results", done.session_id).select("kpi_name", "kpi_value", "kpi_unit", "kpi_category")


def report_tables(spark, folder):
    store, done = _session(spark, folder)
    sections = report.report_tables(store, done.session_id, done.tables, done.types, done.charts)
    out = None
    for i, (name, frame) in enumerate(sections.items()):
        text = frame.select(
            F.lit(i).alias("section_no"), F.lit(name).alias("section"),
            F.concat_ws(" | ", *(F.col(f"`{c}`").cast("string") for c in frame.columns)).alias("line"),
        )
        out = text if out is None else out.unionByName(text)
    return out


_MISSING = ", ".join(f"'{m}'" for m in rules.CSV_MISSING)
_REQUESTS = """
requests AS (
  SELECT ts, upper(event_type) AS method,
    regexp_replace('/api/user/' || user_id || '/item/' || json_extract_string(props, '$.k'), '/[0-9]+', '/:id', 'g') AS path,
    CAST(floor((CASE WHEN event_type = 'error' THEN 500 ELSE 200 END + event_id % 5) / 100) AS INT) || 'xx' AS status_class,
    CASE WHEN value / 10 <= 0.5 THEN 'le_0_5' WHEN value / 10 <= 2 THEN 'le_2' ELSE 'gt_2' END AS bucket
  FROM events)"""
_LATEST = f"""
latest AS (
  SELECT session_id, arg_max(status, (event_at, event_no)) AS status,
    {big("COALESCE(arg_max(total_files, (event_at, event_no)) FILTER (WHERE total_files > 0), 0)")} AS total_files,
    {big("COALESCE(arg_max(total_rows, (event_at, event_no)) FILTER (WHERE total_rows > 0), 0)")} AS total_rows,
    MIN(event_at) AS created_at
  FROM status_events GROUP BY session_id)"""

QUERIES = {
    "csv_ingest": (
        csv_ingest,
        "WITH " + DIRTY_SQL + "\nSELECT "
        + ", ".join(f"CASE WHEN {c} NOT IN ({_MISSING}) THEN {c} END AS {c}" for c in COLUMNS) + " FROM dirty",
    ),
    "encoding_probe": (
        encoding_probe,
        "SELECT * FROM (VALUES ('utf', 'UTF-8'), ('latin', 'ISO-8859-1')) AS e(kind, encoding)"
        " WHERE EXISTS (SELECT 1 FROM part)",
    ),
    "zip_ingest": (zip_ingest, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "table_names": (
        table_names,
        r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1)),
  '[\s.-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS n FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(n, '^_+|_+$', '', 'g'), '_+', '_', 'g') AS n FROM s)
SELECT page_id, 'a3f2c1d4_' || CASE WHEN n = '' THEN 'table' ELSE n END AS table_name FROM t""",
    ),
    "exact_amounts": (
        exact_amounts,
        """SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'small' ELSE 'large' END AS x,
  CAST(SUM(CAST(CASE WHEN o_orderkey % 2 = 1 THEN 0.00001 ELSE 1e15 END AS DECIMAL(38,12))) AS DOUBLE) AS value
FROM orders GROUP BY 1""",
    ),
    "multi_file_load": (
        multi_file_load,
        f"""SELECT CASE WHEN o_orderstatus = 'F' THEN 'a3f2c1d4_orders' ELSE 'a3f2c1d4_2024_orders' END AS table_name,
  {big("COUNT(*)")} AS rows, {big("SUM(o_orderkey)")} AS keys FROM orders GROUP BY 1""",
    ),
    "archive_load": (
        archive_load,
        "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a3f2c1d4_orders' ELSE 'a3f2c1d4_batch_1_orders' END AS table_name,"
        f" {big('o_orderkey')} AS o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    ),
    "skipped_csv_rows": (
        skipped_csv_rows,
        f"""SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'c,d' ELSE 'e' END AS note, {big("COUNT(*)")} AS rows
FROM events GROUP BY 1""",
    ),
    "file_table_names": (
        file_table_names,
        f"""SELECT {big('n_nationkey')} AS n_nationkey, 'a3f2c1d4_' || regexp_replace(lower(n_name), '[ .-]+', '_', 'g')
  || '_' || n_nationkey || '_v2' AS table_name FROM nation""",
    ),
    "session_names": (
        session_names,
        "WITH " + _EVENT_STATUS.strip() + """
SELECT 's' || (CAST(substr(session_id, 2) AS BIGINT) % 5) AS session_id,
  CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 5 = 3 THEN 'Spring sales' END AS session_name,
  arg_max(status, (event_at, event_no)) AS status FROM status_events GROUP BY 1, 2""",
    ),
    "notification_list": (
        notification_list,
        """SELECT state AS "at", 'Event ' || event_id AS title, state = 'after' AS read
FROM events, (VALUES ('before'), ('after')) AS a(state) WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 5 = 2""",
    ),
    "alert_history": (
        alert_history,
        """SELECT 'Event ' || event_id AS title, 'business_alert_' || level AS event_type, level AS severity
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS level FROM events) WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 5 = 1""",
    ),
    "insight_history": (
        insight_history,
        f"""SELECT {big('p_partkey')} AS chart_order, p_type AS insight_text FROM part
WHERE p_partkey % 5 = 1 AND p_size > 20""",
    ),
    "public_dashboard": (
        public_dashboard,
        f"""WITH p AS (SELECT * FROM part WHERE p_partkey % 5 = 1)
SELECT 'chart' AS kind, {big('p_partkey')} AS place, p_name AS text FROM p WHERE p_partkey % 4 IN (0, 2)
UNION ALL SELECT 'insight', {big('p_partkey')}, p_type FROM p WHERE p_size > 20""",
    ),
    "session_latest_status": (
        session_latest_status, "WITH " + _EVENT_STATUS.strip() + "," + _LATEST + "\nSELECT * FROM latest",
    ),
    "session_list": (
        session_overview,
        "WITH " + _EVENT_STATUS.strip() + "," + _LATEST + f""",
f AS (SELECT session_id, COUNT(*) AS file_count, SUM(row_count) AS file_rows,
  arg_min(original_filename, (uploaded_at, original_filename)) AS first_file FROM files GROUP BY session_id)
SELECT l.session_id, 'Dataset ' || substr(l.session_id, 1, 8) AS name, l.status, l.total_files,
  {big("GREATEST(l.total_rows, COALESCE(f.file_rows, 0))")} AS total_rows, l.created_at,
  {big("COALESCE(f.file_count, 0)")} AS file_count, f.first_file
FROM latest l LEFT JOIN f ON l.session_id = f.session_id ORDER BY l.created_at DESC, l.session_id""",
    ),
    "notify_once": (
        notify_once,
        """WITH n AS (SELECT 'u' || user_id AS session_id, event_type, 'Saw ' || event_type AS title,
  json_extract_string(props, '$.k') AS message, ts < TIMESTAMP '2024-01-16' AS early FROM events)
SELECT DISTINCT session_id, event_type, title, message FROM n WHERE NOT early AND NOT EXISTS (
  SELECT 1 FROM n o WHERE o.early AND o.session_id = n.session_id AND o.event_type = n.event_type
    AND o.title = n.title AND o.message = n.message)""",
    ),
    "event_log_rollup": (
        event_log_rollup,
        "WITH " + _REQUESTS.strip() + f"\nSELECT method, path, status_class, bucket, {big('COUNT(*)')} AS requests"
        " FROM requests GROUP BY ALL",
    ),
    "read_only_sql": (
        read_only_sql,
        "SELECT CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Shipped' WHEN 'P' THEN 'Processing'"
        f" ELSE o_orderstatus END AS order_status, {big('COUNT(*)')} AS orders,"
        " CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS paid FROM orders GROUP BY 1",
    ),
    "session_run": (session_run, None),
    "report_tables": (report_tables, None),
}
