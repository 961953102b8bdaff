"""Catalogue: cleaning steps over the dirty orders, one query per step and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.catalog.common import big, plain, rnd
from tablewise.catalog.dirt import DIRTY_SQL, dirty_orders
from tablewise.catalog.profiling import BLANK, moment_sql, number_sql
from tablewise.functions import rules
from tablewise.functions.columns import rounded
from tablewise.operators import clean
from tablewise.operators.profile import profile_table, types_of
from tablewise.operators.quality import outlier_bounds

TEXTS = ("order_id", "customer_id", "order_date", "unit_price", "quantity", "region", "note", "is_gift")


def _start(spark, folder):
    df = dirty_orders(spark, folder)
    profile = profile_table(df, "dirty", samples=False)
    return df, profile, types_of(profile)


def _numbers(df):
    """Imputed and coerced numbers to four digits, flags and dates as they are."""
    return plain(
        df.withColumns({c: rounded(F.col(c), 4) for c in ("unit_price", "quantity") if c in df.columns})
    )


def _coerced(spark, folder):
    df, _, types = _start(spark, folder)
    return clean.coerce_numbers(clean.null_tokens(df), types), types


def _kept(spark, folder):
    df, types = _coerced(spark, folder)
    return clean.drop_missing_ids(clean.drop_duplicates(df), types), types


def _imputed(spark, folder):
    df, types = _kept(spark, folder)
    gaps = [c for c in df.columns if types[c] in ("currency", "numeric", "category", "text")]
    return clean.impute(df, types, clean.imputation_values(df, types, gaps)), types


def clean_null_tokens(spark, folder):
    return clean.null_tokens(dirty_orders(spark, folder))


def clean_numeric_coerce(spark, folder):
    return _numbers(_coerced(spark, folder)[0].select("order_id", "unit_price", "quantity"))


def clean_dedupe(spark, folder):
    return _numbers(clean.drop_duplicates(_coerced(spark, folder)[0]))


def clean_drop_missing_ids(spark, folder):
    return _numbers(_kept(spark, folder)[0])


def clean_impute(spark, folder):
    return _numbers(_imputed(spark, folder)[0])


def clean_datetime(spark, folder):
    df, types = _imputed(spark, folder)
    return plain(clean.parse_dates(df, types).select("order_id", "order_date"))


def clean_strip(spark, folder):
    return plain(clean.strip_text(_imputed(spark, folder)[0]).select("order_id", "customer_id", "region", "note"))


def clean_title_case(spark, folder):
    df, types = _imputed(spark, folder)
    return clean.title_categories(clean.strip_text(df), types).select("order_id", "region")


def clean_outlier_flags(spark, folder):
    df, types = _imputed(spark, folder)
    bounds = outlier_bounds(df, clean.numeric_columns(df, types))
    flagged = clean.flag_outliers(df, types, bounds)
    return _numbers(
        flagged.select("order_id", "unit_price", "quantity", "is_outlier_unit_price", "is_outlier_quantity")
    )


def clean_whole_table(spark, folder):
    df, profile, _ = _start(spark, folder)
    return _numbers(clean.clean_table(df, "dirty", profile).df)


def cleaning_log(spark, folder):
    df, profile, _ = _start(spark, folder)
    log = clean.clean_table(df, "dirty", profile).log_frame()
    return log.select("step", F.coalesce("column_name", F.lit("")).alias("column_name"), "affected", "level")


def cleaning_messages(spark, folder):
    df, profile, _ = _start(spark, folder)
    return clean.clean_table(df, "dirty", profile).log_frame()


_TOKENS = ", ".join(f"'{t}'" for t in rules.NULL_TOKENS)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"


def _token(c: str) -> str:
    return f"lower({_strip(c)}) IN ({_TOKENS})"


_C1 = "c1 AS (SELECT " + ", ".join(f"CASE WHEN NOT ({_token(c)}) THEN {c} END AS {c}" for c in TEXTS) + " FROM dirty)"
_C2 = (
    "c2 AS (SELECT * REPLACE ("
    + ", ".join(f"{number_sql(c)} AS {c}" for c in ("unit_price", "quantity"))
    + ") FROM c1)"
)
_C3 = "c3 AS (SELECT DISTINCT * FROM c2)"
_C4 = "c4 AS (SELECT * FROM c3 WHERE order_id IS NOT NULL AND customer_id IS NOT NULL)"
_FLAG = f"""CASE WHEN lower({_strip("is_gift")}) IN ('yes', 'true', 'y', '1', 't') THEN TRUE ELSE FALSE END"""
_C5 = f"""c5 AS (SELECT * REPLACE (
  COALESCE(unit_price, (SELECT quantile_cont(unit_price, 0.5) FROM c4)) AS unit_price,
  COALESCE(quantity, (SELECT quantile_cont(quantity, 0.5) FROM c4)) AS quantity,
  COALESCE(region, (SELECT region FROM c4 WHERE region IS NOT NULL GROUP BY region
                    ORDER BY COUNT(*) DESC, region LIMIT 1)) AS region,
  COALESCE(note, (SELECT note FROM c4 WHERE note IS NOT NULL GROUP BY note
                  ORDER BY COUNT(*) DESC, note LIMIT 1), 'Unknown') AS note,
  {_FLAG} AS is_gift) FROM c4)"""
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(lower({v}), '[[:alpha:]]+|[^[:alpha:]]+'),"
    " lambda r: upper(r[1]) || r[2:]), '')"
)
_C8 = f"""c8 AS (SELECT order_id, {_strip("customer_id")} AS customer_id, {moment_sql("order_date")} AS order_date,
  unit_price, quantity, {_TITLE.format(v=_strip("region"))} AS region, {_strip("note")} AS note, is_gift FROM c5)"""


def _outside(c: str) -> str:
    return f"({c} < {c}_q1 - 3 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 3 * ({c}_q3 - {c}_q1)) AND {c}_q3 <> {c}_q1"


_C9 = f"""bounds AS (SELECT quantile_cont(unit_price, 0.25) AS unit_price_q1, quantile_cont(unit_price, 0.75) AS unit_price_q3,
  quantile_cont(quantity, 0.25) AS quantity_q1, quantile_cont(quantity, 0.75) AS quantity_q3 FROM c5),
c9 AS (SELECT c8.*, {_outside("unit_price")} AS is_outlier_unit_price, {_outside("quantity")} AS is_outlier_quantity
  FROM c8, bounds)"""


def _steps(body: str, last: int) -> str:
    parts = [DIRTY_SQL, _C1, _C2, _C3, _C4, _C5, _C8, _C9]
    return "WITH " + ",\n".join(parts[: last + 1]) + "\n" + body


_NUMS = f"{rnd('unit_price', 4)} AS unit_price, {rnd('quantity', 4)} AS quantity"


def _replaced(table: str) -> str:
    return f"SELECT * REPLACE ({_NUMS}) FROM {table}"


_LOG = f"""
SELECT 'null_tokens' AS step, '' AS column_name, (SELECT {" + ".join(f"COUNT(*) FILTER (WHERE {_token(c)})" for c in TEXTS)} FROM dirty) AS affected, 'action' AS level
UNION ALL SELECT 'coerce_numbers', 'unit_price', (SELECT COUNT(*) FROM c1 WHERE unit_price IS NOT NULL AND {number_sql("unit_price")} IS NULL), 'action'
UNION ALL SELECT 'coerce_numbers', 'quantity', (SELECT COUNT(*) FROM c1 WHERE quantity IS NOT NULL AND {number_sql("quantity")} IS NULL), 'action'
UNION ALL SELECT 'duplicates', '', (SELECT COUNT(*) FROM c2) - (SELECT COUNT(*) FROM c3), 'action'
UNION ALL SELECT 'missing_ids', 'order_id', (SELECT COUNT(*) FROM c3 WHERE order_id IS NULL), 'action'
UNION ALL SELECT 'impute', c, n, 'action' FROM (
  SELECT COUNT(*) - COUNT(order_date) AS order_date, COUNT(*) - COUNT(unit_price) AS unit_price,
         COUNT(*) - COUNT(quantity) AS quantity, COUNT(*) - COUNT(region) AS region,
         COUNT(*) - COUNT(note) AS note, COUNT(*) - COUNT(is_gift) AS is_gift FROM c4)
  UNPIVOT (n FOR c IN (order_date, unit_price, quantity, region, note, is_gift)) WHERE n > 0
UNION ALL SELECT 'dates', 'order_date', (SELECT COUNT(*) FROM c8 WHERE order_date IS NULL), 'warning'
UNION ALL SELECT 'strip', '', (SELECT COUNT(*) FILTER (WHERE {_strip("order_id")} <> order_id)
  + COUNT(*) FILTER (WHERE {_strip("customer_id")} <> customer_id)
  + COUNT(*) FILTER (WHERE {_strip("region")} <> region) + COUNT(*) FILTER (WHERE {_strip("note")} <> note) FROM c5), 'action'
UNION ALL SELECT 'title', '', (SELECT COUNT(*) FILTER (WHERE {_TITLE.format(v=_strip("region"))} <> {_strip("region")}) FROM c5), 'action'
UNION ALL SELECT 'outliers', 'unit_price', (SELECT COUNT(*) FROM c9 WHERE is_outlier_unit_price), 'action'"""

QUERIES = {
    "clean_null_tokens": (clean_null_tokens, _steps("SELECT * FROM c1", 1)),
    "clean_numeric_coerce": (clean_numeric_coerce, _steps(f"SELECT order_id, {_NUMS} FROM c2", 2)),
    "clean_dedupe": (clean_dedupe, _steps(_replaced("c3"), 3)),
    "clean_drop_missing_ids": (clean_drop_missing_ids, _steps(_replaced("c4"), 4)),
    "clean_impute": (clean_impute, _steps(_replaced("c5"), 5)),
    "clean_datetime": (clean_datetime, _steps("SELECT order_id, order_date FROM c8", 6)),
    "clean_strip": (
        clean_strip,
        _steps(f"SELECT order_id, customer_id, {_strip('region')} AS region, note FROM c5", 6),
    ),
    "clean_title_case": (clean_title_case, _steps("SELECT order_id, region FROM c8", 6)),
    "clean_outlier_flags": (
        clean_outlier_flags,
        _steps(f"SELECT order_id, {_NUMS}, is_outlier_unit_price, is_outlier_quantity FROM c9", 7),
    ),
    "clean_whole_table": (clean_whole_table, _steps(_replaced("c9"), 7)),
    "cleaning_log": (
        cleaning_log,
        _steps(f"SELECT step, column_name, {big('affected')} AS affected, level FROM ({_LOG})", 7),
    ),
    "cleaning_messages": (cleaning_messages, None),
}
