"""Catalogue: profiles, semantic types and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tablewise.catalog.common import big, plain, rnd
from tablewise.catalog.dirt import COLUMNS, DIRTY_SQL, dirty_orders
from tablewise.functions import rules
from tablewise.operators import profile as prof
from tablewise.operators import profile_state as state
from tablewise.operators import quality
from tablewise.session import per_table, stage
from tablewise.sources.mart import Mart
from tablewise.sources.tables import read_table

RAW = {
    "region": ("r_regionkey:whole", "r_name:text"),
    "nation": ("n_nationkey:whole", "n_name:text", "n_regionkey:whole"),
    "customer": (
        "c_custkey:whole", "c_name:text", "c_nationkey:whole", "c_acctbal:real", "c_mktsegment:text",
    ),
    "supplier": ("s_suppkey:whole", "s_name:text", "s_nationkey:whole", "s_acctbal:real"),
    "part": (
        "p_partkey:whole", "p_name:text", "p_brand:text", "p_type:text", "p_size:whole",
        "p_retailprice:real",
    ),
    "orders": (
        "o_orderkey:whole", "o_custkey:whole", "o_orderstatus:text", "o_totalprice:real",
        "o_orderdate:moment", "o_orderpriority:text",
    ),
    "lineitem": (
        "l_orderkey:whole", "l_partkey:whole", "l_suppkey:whole", "l_linenumber:whole",
        "l_quantity:real", "l_extendedprice:real", "l_discount:real", "l_tax:real",
        "l_returnflag:text", "l_linestatus:text", "l_shipdate:moment",
    ),
    "events": (
        "event_id:whole", "ts:moment", "user_id:whole", "event_type:text", "value:real", "props:text",
    ),
    "documents": ("doc_id:whole", "text:text", "lang:text", "source:text", "n_chars:whole"),
    "labels": ("doc_id:whole", "quality:whole", "toxic:whole"),
    "pages": ("page_id:whole", "url:text", "html:text"),
    "conversations": ("conv_id:whole", "turn:whole", "role:text", "text:text"),
    "benchmark": ("item_id:whole", "text:text"),
    "embeddings": ("vec_id:whole", "embedding:list", "label:whole"),
}
KEYED = {
    "keyed_orders": (
        "order_id:text", "customer_id:text", "order_status:text", "order_purchase_timestamp:moment",
        "payment_value:real",
    ),
    "keyed_items": (
        "order_id:text", "product_id:text", "seller_id:text", "order_item_id:whole", "price:real",
        "freight_value:real",
    ),
    "keyed_products": ("product_id:text", "product_category_name:text"),
    "keyed_customers": (
        "customer_id:text", "customer_unique_id:text", "customer_city:text", "customer_state:text",
    ),
}
DIRTY = {"dirty": tuple(f"{c}:text" for c in COLUMNS)}

KEYED_SQL = """
keyed_orders AS (
  SELECT 'O' || o_orderkey AS order_id, 'C' || o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Shipped'
              WHEN 'P' THEN 'Processing' ELSE o_orderstatus END AS order_status,
         o_orderdate AS order_purchase_timestamp, CAST(o_totalprice AS DECIMAL(18,2)) AS payment_value
  FROM orders),
keyed_items AS (
  SELECT 'O' || l_orderkey AS order_id, 'P' || l_partkey AS product_id, 'S' || l_suppkey AS seller_id,
         l_linenumber AS order_item_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS freight_value
  FROM lineitem),
keyed_products AS (SELECT 'P' || p_partkey AS product_id, p_type AS product_category_name FROM part),
keyed_customers AS (
  SELECT 'C' || c_custkey AS customer_id, c_name AS customer_unique_id, c_mktsegment AS customer_city,
         n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""

BLANK = "[ \\t\\n\\r\\f]+"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _words(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def moment_sql(text: str) -> str:
    """The date formats that occur in the checked tables, in the documented order."""
    v = f"regexp_replace({text}, '^{BLANK}|{BLANK}$', '', 'g')"
    return f"""CASE WHEN regexp_matches({v}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}([ T].*)?$')
      THEN TRY_CAST({v} AS TIMESTAMP)
      WHEN regexp_matches({v}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$')
      THEN COALESCE(TRY_STRPTIME({v}, '%m/%d/%Y'), TRY_STRPTIME({v}, '%d/%m/%Y')) END"""


def number_sql(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def _has(name: str, words) -> str:
    return "TRUE" if any(w in name for w in words) else "FALSE"


def _stats_sql(table: str, order: int, spec: str) -> str:
    """Statistics of one column of one table, straight from its rows."""
    name, kind = spec.split(":")
    c = f'"{name}"'
    word = f"lower(regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g'))"
    number = {"text": number_sql(c), "whole": f"CAST({c} AS DOUBLE)", "real": f"CAST({c} AS DOUBLE)"}.get(
        kind, "CAST(NULL AS DOUBLE)"
    )
    moment = moment_sql(c) if kind == "text" else "CAST(NULL AS TIMESTAMP)"
    sets = " OR ".join(
        f"COUNT(*) FILTER (WHERE {word} NOT IN ({_words(s)})) = 0" for s in rules.BOOLEAN_SETS
    )
    flags = f"({sets})" if kind == "text" else "FALSE"
    whole_texts = f"COUNT(*) FILTER (WHERE regexp_matches({c}, '^\\s*[+-]?\\d+\\s*$'))" if kind == "text" else "0"
    return f"""
SELECT '{table}' AS table_name, '{name}' AS column_name, {order} AS column_order, '{kind}' AS kind,
       COUNT(*) AS total, COUNT({c}) AS filled, COUNT(DISTINCT {c}) AS uniq,
       COUNT({number}) AS numbers, {whole_texts} AS wholes, MIN({number}) AS low, MAX({number}) AS high,
       AVG({number}) AS mean, COALESCE(BOOL_OR({number} % 1 <> 0), FALSE) AS fraction,
       COUNT({moment}) AS moments, {flags} AS flags,
       {_has(name, rules.DATE_WORDS)} AS date_word, {_has(name, rules.ID_WORDS)} AS id_word,
       {_has(name, rules.CURRENCY_WORDS)} AS currency_word,
       {"TRUE" if name.startswith(rules.BOOLEAN_PREFIXES) else "FALSE"} AS flag_name
FROM {table}"""


def _numeric_sql(whole: str) -> str:
    return f"""CASE
    WHEN {whole} AND ((id_word AND uniq >= 0.95 * total)
      OR (uniq = filled AND low IN (0, 1) AND (high - low + 1 - filled) / (high - low + 1) <= 0.05)) THEN 'id'
    WHEN currency_word THEN 'currency'
    WHEN NOT ({whole}) AND fraction AND mean > 1 AND high > 1 THEN 'currency'
    ELSE 'numeric' END"""


def _types_sql(tables: dict) -> str:
    stats = "\nUNION ALL".join(
        _stats_sql(t, i, spec) for t, specs in tables.items() for i, spec in enumerate(specs)
    )
    date = "kind = 'text' AND filled >= 10 AND moments >= 0.85 * filled"
    return f"""stats AS ({stats}),
typed AS (SELECT *, CASE
  WHEN filled = 0 THEN 'text'
  WHEN flag_name OR flags OR (kind = 'whole' AND low >= 0 AND high <= 1) THEN 'boolean'
  WHEN kind = 'moment' THEN 'datetime'
  WHEN date_word AND {date} THEN 'datetime'
  WHEN kind = 'whole' THEN {_numeric_sql("TRUE")}
  WHEN kind = 'real' THEN {_numeric_sql("FALSE")}
  WHEN numbers >= 0.95 * filled THEN {_numeric_sql("wholes = filled")}
  WHEN {date} THEN 'datetime'
  WHEN id_word AND (uniq >= 0.95 * total OR (uniq >= 10 AND uniq >= 0.001 * total)) THEN 'id'
  WHEN uniq >= 0.99 * total AND uniq > 100 THEN 'id'
  WHEN uniq <= 0.05 * total OR uniq <= 50 THEN 'category' ELSE 'text' END AS detected_type
  FROM stats)"""


PROFILE_COLUMNS = f"""table_name, column_name, detected_type, {big("total - filled")} AS null_count,
  {rnd("CAST(total - filled AS DOUBLE) / total * 100")} AS null_percent, {big("uniq")} AS unique_count,
  {big("column_order")} AS column_order"""


def _profile_sql(tables: dict, *parts: str) -> str:
    return "WITH " + ",\n".join([*parts, _types_sql(tables)]) + f"\nSELECT {PROFILE_COLUMNS} FROM typed"


def _keyed_tables(spark, folder):
    mart = Mart(spark, folder, text_ids=True)
    return {
        "keyed_orders": mart.orders.drop("order_priority"),
        "keyed_items": mart.items,
        "keyed_products": mart.products,
        "keyed_customers": mart.customers,
    }


def _profile(df, name):
    return prof.profile_frame(df, name).select(
        "table_name", "column_name", "detected_type", "null_count", "null_percent", "unique_count",
        "column_order",
    )


def _column_profile(table):
    def run(spark, folder):
        return plain(_profile(read_table(spark, folder, table), table))

    run.__name__ = f"column_profile_{table}"
    return run


def column_profile_dirty(spark, folder):
    return plain(_profile(dirty_orders(spark, folder), "dirty"))


def semantic_types(spark, folder):
    tables = {t: read_table(spark, folder, t) for t in RAW} | _keyed_tables(spark, folder)
    frames = per_table(
        lambda name, df: _profile(df, name).select("table_name", "column_name", "detected_type"), tables
    )
    return reduce(lambda a, b: a.unionByName(b), frames.values())


def filter_metadata(spark, folder):
    tables = {t: read_table(spark, folder, t) for t in _FILTER_TABLES}
    frames = per_table(
        lambda name, df: prof.filter_fields(df, name, prof.profile_table(df, name, samples=False)), tables
    )
    fields = reduce(lambda a, b: a.unionByName(b), frames.values())
    return fields.withColumn("values", F.array_join("values", "|"))


def filter_values(spark, folder):
    tables = {t: read_table(spark, folder, t) for t in RAW}
    frames = per_table(
        lambda name, df: prof.filter_values(df, name, prof.profile_table(df, name, samples=False)), tables
    )
    return reduce(lambda a, b: a.unionByName(b), frames.values())


def _values_sql() -> str:
    """Every value of every column, of which the category columns are kept."""
    lists = [
        f"SELECT DISTINCT '{t}' AS table_name, '{spec.split(':')[0]}' AS column_name, CAST(\"{spec.split(':')[0]}\" AS VARCHAR) AS value FROM {t}"
        for t, specs in RAW.items() for spec in specs if spec.endswith(":text")
    ]
    return (
        "WITH " + _types_sql(RAW) + ",\nlists AS (" + "\nUNION ALL ".join(lists) + ")\n"
        "SELECT table_name AS \"table\", column_name AS \"column\", value FROM typed JOIN lists USING (table_name, column_name)"
        " WHERE detected_type = 'category' AND value IS NOT NULL"
    )


def profile_merged(spark, folder):
    """The profile of every table from the states of three parts of its rows, each read once."""

    def one(name, df):
        parts, first = None, F.pmod(F.xxhash64(F.col(f"`{df.columns[0]}`")), F.lit(3))
        for part in range(3):
            parts = stage(state.add_part(parts, df.filter(first == part), name), "profile-state")
        return parts

    states = per_table(one, {t: read_table(spark, folder, t) for t in RAW})
    found = state.profile_of(reduce(lambda a, b: a.unionByName(b), states.values()))
    texts = [f"{t}.{spec.split(':')[0]}" for t, specs in RAW.items() for spec in specs if spec.endswith(":text")]
    is_text = F.concat_ws(".", "table_name", "column_name").isin(texts)
    samples = F.array_join(F.transform("samples", lambda v: F.md5(v.cast("binary"))), "|")
    return found.select(
        "table_name", "column_name", "total_rows", "null_count", "null_percent", "numbers", "low", "high",
        F.when(is_text, F.col("longest")).alias("longest"), F.when(is_text, samples).alias("samples"),
    )


def _merged_sql() -> str:
    parts = []
    for t, specs in RAW.items():
        for spec in specs:
            name, kind = spec.split(":")
            c = f'"{name}"'
            v = number_sql(c) if kind == "text" else f"CAST({c} AS DOUBLE)" if kind in ("whole", "real") else "CAST(NULL AS DOUBLE)"
            longest, samples = "NULL", "NULL"
            if kind == "text":
                longest = f"MAX(length({c}))"
                marks = f"(SELECT DISTINCT md5({c}) AS m FROM {t} WHERE {c} IS NOT NULL ORDER BY m LIMIT {rules.SAMPLE_VALUES})"
                samples = f"(SELECT string_agg(m, '|' ORDER BY m) FROM {marks} AS marks)"
            parts.append(f"""
SELECT '{t}' AS table_name, '{name}' AS column_name, {big("COUNT(*)")} AS total_rows, {big(f"COUNT(*) - COUNT({c})")} AS null_count,
  {rnd(f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100")} AS null_percent, {big(f"COUNT({v})")} AS numbers,
  MIN({v}) + 0.0 AS low, MAX({v}) + 0.0 AS high, {big(longest)} AS longest, CAST({samples} AS VARCHAR) AS samples FROM {t}""")
    return "\nUNION ALL ".join(parts)


def schema_nested(spark, folder):
    frames = [_profile(read_table(spark, folder, t), t) for t in RAW]
    nested = prof.nested_schema(reduce(lambda a, b: a.unionByName(b), frames))
    text = F.transform(
        "columns", lambda c: F.concat_ws(":", c["column_order"].cast("string"), c["column_name"], c["detected_type"])
    )
    return nested.select("table_name", F.array_join(text, "|").alias("columns"))


def schema_search(spark, folder):
    frames = [_profile(read_table(spark, folder, t), t) for t in _NESTED_TABLES]
    found = prof.search_fields(reduce(lambda a, b: a.unionByName(b), frames), "Date")
    return found.select("table_name", "column_name", "detected_type")


def dataset_summary(spark, folder):
    tables = _score_tables(spark, folder)
    profiles = per_table(lambda name, df: prof.profile_table(df, name, samples=False), tables)
    reports = per_table(lambda name, df: quality.quality_report(df, name, profiles[name]), tables)
    scores = reduce(lambda a, b: a.unionByName(b), reports.values())
    return plain(prof.dataset_summary(prof.profiles_to_frame(spark, profiles), scores))


def duplicate_rows(spark, folder):
    tables = {t: read_table(spark, folder, t) for t in RAW} | {"dirty": dirty_orders(spark, folder)}
    frames = [
        quality.duplicate_count(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()
    ]
    return plain(reduce(lambda a, b: a.unionByName(b), frames))


def null_quality(spark, folder):
    stats = prof.profile_frame(dirty_orders(spark, folder), "dirty")
    share = F.col("null_percent") / 100
    points = (
        F.when(share == 1.0, rules.POINTS_MANY_NULLS)
        .when(share > rules.NULLS_CRITICAL, rules.POINTS_NULL_COLUMN + rules.POINTS_MANY_NULLS)
        .when(share > rules.NULLS_WARNING, rules.POINTS_NULL_COLUMN)
        .otherwise(0)
    )
    return plain(stats.select("column_name", "null_count", "null_percent", points.alias("points")))


OUTLIER_TABLES = tuple(RAW)


def _score_tables(spark, folder):
    return {t: read_table(spark, folder, t) for t in OUTLIER_TABLES} | {"dirty": dirty_orders(spark, folder)}


def _outliers(name, df):
    likely = df.select(*(F.col(f"`{c}`") for c in prof.number_candidates(df)))
    profile = prof.profile_table(likely, name, samples=False) if likely.columns else []
    columns = [p.column_name for p in profile if p.detected_type in ("numeric", "currency")]
    return [(name, c, n) for c, n in quality.count_outliers(df, columns).items()]


def outlier_columns(spark, folder):
    return spark.createDataFrame(
        [row for rows in per_table(_outliers, _score_tables(spark, folder)).values() for row in rows],
        "table_name string, column_name string, outlier_count long"
    )


def _reports(spark, folder):
    reports = per_table(
        lambda name, df: quality.quality_report(df, name, prof.profile_table(df, name, samples=False)),
        _score_tables(spark, folder),
    )
    return reduce(lambda a, b: a.unionByName(b), reports.values())


def quality_scores(spark, folder):
    return plain(
        _reports(spark, folder).select(
            "table_name", "quality_score", "total_rows", "total_columns", "duplicate_rows",
            "columns_with_nulls", "outlier_columns", quality.level_of(F.col("quality_score")).alias("level"),
        )
    )


def quality_summaries(spark, folder):
    reports = _reports(spark, folder)
    return reports.select(
        "table_name", "summary", F.array_join("issues_found", " | ").alias("issues"),
        F.array_join("actions_taken", " | ").alias("actions"),
    )


def outlier_notice(spark, folder):
    return quality.outlier_notice(_reports(spark, folder))


_OUTLIER_SPECS = {t: RAW[t] for t in OUTLIER_TABLES} | DIRTY


def _outlier_sql() -> str:
    """Typed columns and the number of values beyond three quartile ranges."""
    parts = []
    for table, specs in _OUTLIER_SPECS.items():
        for spec in specs:
            name, kind = spec.split(":")
            if kind not in ("whole", "real", "text"):
                continue
            v = number_sql(f'"{name}"') if kind == "text" else f'CAST("{name}" AS DOUBLE)'
            parts.append(f"""
SELECT '{table}' AS table_name, '{name}' AS column_name, COUNT(v) AS n,
       COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS beyond, MAX(q3 - q1) AS spread
FROM (SELECT {v} AS v FROM {table}) AS vals,
     (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {table}) AS bounds""")
    union = "\nUNION ALL".join(parts)
    return f"""
spreads AS ({union}),
outliers AS (
  SELECT t.table_name, t.column_name,
         CASE WHEN s.n >= 10 AND s.spread <> 0 THEN s.beyond ELSE 0 END AS outlier_count
  FROM typed t JOIN spreads s ON t.table_name = s.table_name AND t.column_name = s.column_name
  WHERE t.detected_type IN ('numeric', 'currency'))"""


def _duplicates_sql(tables) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, {big('SUM(n)')} AS total_rows, {big('SUM(n - 1)')} AS duplicate_rows"
        f" FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY ALL_COLUMNS)".replace(
            "GROUP BY ALL_COLUMNS", "GROUP BY " + ", ".join(f'"{s.split(":")[0]}"' for s in specs)
        )
        for t, specs in tables.items()
    )


_SCORES = f"""
points AS (
  SELECT t.table_name, CASE WHEN filled = 0 AND total > 0 THEN 10
      WHEN total - filled > 0.30 * total THEN 15 WHEN total - filled > 0.05 * total THEN 5 ELSE 0 END
    + CASE WHEN COALESCE(o.outlier_count, 0) > 0 THEN 5 ELSE 0 END
    + CASE WHEN kind = 'text' AND detected_type IN ('numeric', 'currency') AND numbers < filled THEN 8 ELSE 0 END
    AS points,
    CASE WHEN total - filled > 0.05 * total THEN 1 ELSE 0 END AS null_column,
    CASE WHEN COALESCE(o.outlier_count, 0) > 0 THEN 1 ELSE 0 END AS outlier_column
  FROM typed t LEFT JOIN outliers o ON t.table_name = o.table_name AND t.column_name = o.column_name),
dup AS ({_duplicates_sql(_OUTLIER_SPECS)}),
scores AS (
  SELECT d.table_name, {big("GREATEST(0, 100 - SUM(p.points) - MAX(CASE WHEN d.duplicate_rows > 0.01 * d.total_rows THEN 15 ELSE 0 END))")}
           AS quality_score, MAX(d.total_rows) AS total_rows, {big("COUNT(*)")} AS total_columns,
         MAX(d.duplicate_rows) AS duplicate_rows, {big("SUM(p.null_column)")} AS columns_with_nulls,
         {big("SUM(p.outlier_column)")} AS outlier_columns
  FROM dup d JOIN points p ON d.table_name = p.table_name GROUP BY d.table_name)"""

_LEVEL = """CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good'
  WHEN quality_score >= 50 THEN 'moderate' ELSE 'poor' END"""


def _with_scores(body: str) -> str:
    return "WITH " + ",\n".join([DIRTY_SQL, _types_sql(_OUTLIER_SPECS), _outlier_sql(), _SCORES]) + body


def _summaries_sql() -> str:
    """The sentences of every table's findings, in their order."""
    fills = " ".join(f"WHEN '{kind}' THEN '{text}'" for kind, text in rules.IMPUTATION_TEXT.items())
    return _with_scores(f""",
issues AS (
  SELECT table_name, 1 AS at_, CAST(-1 AS BIGINT) AS place, printf('%d rows repeat others (%.1f%%)', duplicate_rows, duplicate_rows * 100.0 / total_rows) AS found,
    printf('Cleaning removes %d repeated rows', duplicate_rows) AS done FROM dup WHERE duplicate_rows > 0
  UNION ALL
  SELECT table_name, 2, column_order, column_name || ' holds no value at all', column_name || ': cleaning writes ''Unknown'''
  FROM typed WHERE filled = 0 AND total > 0
  UNION ALL
  SELECT table_name, 2, column_order, printf('%s lacks %d values (%.1f%%)', column_name, total - filled, ROUND((total - filled) * 100.0 / total, 2)),
    column_name || ': ' || CASE detected_type {fills} END FROM typed WHERE filled > 0 AND total - filled > 0.05 * total
  UNION ALL
  SELECT t.table_name, 3, column_order, printf('%s holds %d extreme values (%.1f%%)', t.column_name, outlier_count, outlier_count * 100.0 / total),
    t.column_name || ': cleaning marks them in is_outlier_' || t.column_name || ' and keeps them'
  FROM typed t JOIN outliers o ON t.table_name = o.table_name AND t.column_name = o.column_name WHERE outlier_count > 0
  UNION ALL
  SELECT table_name, 4, column_order, column_name || ' mixes numbers with other text', column_name || ': cleaning reads the numbers and fills the rest'
  FROM typed WHERE kind = 'text' AND detected_type IN ('numeric', 'currency') AND numbers < filled),
told AS (SELECT table_name, string_agg(found, ' | ' ORDER BY at_, place) AS issues, string_agg(done, ' | ' ORDER BY at_, place) AS actions FROM issues GROUP BY 1),
parts AS (SELECT *, {_LEVEL} AS level, concat_ws(', ', CASE WHEN duplicate_rows > 0 THEN duplicate_rows || ' repeated rows' END,
    CASE WHEN columns_with_nulls > 0 THEN columns_with_nulls || ' columns with gaps' END,
    CASE WHEN outlier_columns > 0 THEN outlier_columns || ' columns with extreme values' END) AS text FROM scores)
SELECT p.table_name, 'Quality: ' || level || ', ' || quality_score || ' of 100 points. '
    || CASE WHEN text = '' THEN 'Nothing was found.' ELSE 'Found: ' || text || '. Cleaning takes care of them.' END AS summary,
  coalesce(issues, '') AS issues, coalesce(actions, '') AS actions
FROM parts p LEFT JOIN told t ON p.table_name = t.table_name""")


_FILTER_TABLES = RAW


def _filter_sql() -> str:
    dates, values = [], []
    for t, specs in _FILTER_TABLES.items():
        for spec in specs:
            name, kind = spec.split(":")
            if kind == "moment":
                dates.append(
                    f"SELECT '{t}' AS \"table\", '{name}' AS \"column\", 'date' AS type,"
                    f" CAST(CAST(MIN({name}) AS DATE) AS VARCHAR) AS min,"
                    f" CAST(CAST(MAX({name}) AS DATE) AS VARCHAR) AS max, '' AS \"values\" FROM {t}"
                )
            elif kind == "text":
                values.append(
                    f"SELECT '{t}' AS table_name, '{name}' AS column_name,"
                    f" string_agg(DISTINCT {name}, '|' ORDER BY {name}) AS vs FROM {t}"
                )
    return (
        "WITH " + _types_sql(_FILTER_TABLES) + ",\nlists AS (" + "\nUNION ALL ".join(values) + ")\n"
        + "\nUNION ALL ".join(dates)
        + "\nUNION ALL SELECT t.table_name, t.column_name, 'category', NULL, NULL, l.vs FROM typed t"
        " LEFT JOIN lists l ON t.table_name = l.table_name AND t.column_name = l.column_name AND t.uniq <= 50"
        " WHERE t.detected_type = 'category'"
    )


_NESTED_TABLES = RAW

QUERIES = {
    **{
        f"column_profile_{t}": (_column_profile(t), _profile_sql({t: RAW[t]}))
        for t in ("orders", "lineitem", "documents", "events")
    },
    "column_profile_dirty": (column_profile_dirty, _profile_sql(DIRTY, DIRTY_SQL)),
    "semantic_types": (
        semantic_types,
        "WITH " + KEYED_SQL.strip() + ",\n" + _types_sql(RAW | KEYED)
        + "\nSELECT table_name, column_name, detected_type FROM typed",
    ),
    "filter_metadata": (filter_metadata, _filter_sql()),
    "filter_values": (filter_values, _values_sql()),
    "profile_merged": (profile_merged, _merged_sql()),
    "schema_nested": (
        schema_nested,
        "WITH " + _types_sql(_NESTED_TABLES) + """
SELECT table_name, string_agg(column_order || ':' || column_name || ':' || detected_type, '|'
       ORDER BY column_order) AS columns FROM typed GROUP BY table_name""",
    ),
    "schema_search": (
        schema_search,
        "WITH " + _types_sql(_NESTED_TABLES) + """
SELECT table_name, column_name, detected_type FROM typed
WHERE contains(lower(table_name || ' ' || column_name || ' ' || detected_type), 'date')""",
    ),
    "dataset_summary": (
        dataset_summary,
        _with_scores(f"""
SELECT {big("COUNT(*)")} AS tables, (SELECT {big("COUNT(*)")} FROM typed) AS fields, {big("SUM(total_rows)")} AS total_rows,
  (SELECT {rnd("100 - AVG(" + rnd("CAST(total - filled AS DOUBLE) / total * 100") + ")")} FROM typed) AS completeness,
  {big("FLOOR(AVG(quality_score))")} AS overall_quality FROM scores"""),
    ),
    "duplicate_rows": (duplicate_rows, "WITH " + DIRTY_SQL + "\n" + _duplicates_sql(RAW | DIRTY)),
    "null_quality": (
        null_quality,
        "WITH " + DIRTY_SQL + ",\n" + _types_sql(DIRTY) + f"""
SELECT column_name, {big("total - filled")} AS null_count,
       {rnd("CAST(total - filled AS DOUBLE) / total * 100")} AS null_percent,
       {big("CASE WHEN filled = 0 THEN 10 WHEN total - filled > 0.30 * total THEN 15 WHEN total - filled > 0.05 * total THEN 5 ELSE 0 END")}
         AS points FROM typed""",
    ),
    "outlier_columns": (
        outlier_columns,
        "WITH " + ",\n".join([DIRTY_SQL, _types_sql(_OUTLIER_SPECS), _outlier_sql()])
        + f"\nSELECT table_name, column_name, {big('outlier_count')} AS outlier_count FROM outliers",
    ),
    "quality_scores": (quality_scores, _with_scores(f"\nSELECT *, {_LEVEL} AS level FROM scores")),
    "quality_summaries": (quality_summaries, _summaries_sql()),
    "outlier_notice": (
        outlier_notice,
        _with_scores("""
SELECT 'anomaly_detected' AS event_type, 'Anomalies detected' AS title,
       'Values far from the rest were marked in ' || string_agg(table_name || ' (' || outlier_columns
         || ' column(s))', ', ' ORDER BY table_name) || '.' AS message
FROM scores WHERE outlier_columns > 0 HAVING COUNT(*) > 0"""),
    ),
}
