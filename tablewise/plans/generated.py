"""Summary views that follow from the semantic types of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import names, rules
from tablewise.functions.columns import exact_amount, month_of, ratio, rounded
from tablewise.plans.curated import share_of_total


def _typed(types: Mapping[str, str], kind: str) -> list[str]:
    return [c for c, t in types.items() if t == kind]


def _amounts(df: DataFrame, key, value: str) -> DataFrame:
    amount = exact_amount(F.col(f"`{value}`"), df.schema[value].dataType)
    return df.select(key.alias("key"), amount.alias("amount")).filter(
        F.col("key").isNotNull() & F.col("amount").isNotNull()
    )


def _measures(count_name: str, *which: str) -> list:
    all_of = {
        "total_value": rounded(F.sum("amount"), 2),
        "avg_value": rounded(ratio(F.sum("amount"), F.count("amount")), 2),
        "min_value": rounded(F.min("amount"), 2),
        "max_value": rounded(F.max("amount"), 2),
    }
    return [F.count("*").alias(count_name), *(all_of[w].alias(w) for w in which)]


def time_series(df: DataFrame, date_column: str, value_column: str) -> DataFrame:
    rows = _amounts(df, month_of(F.col(f"`{date_column}`")), value_column)
    out = rows.groupBy(F.col("key").alias("period")).agg(
        *_measures("record_count", "total_value", "avg_value", "min_value", "max_value")
    )
    return out.orderBy("period")


def by_category(df: DataFrame, category_column: str, value_column: str) -> DataFrame:
    rows = _amounts(df, F.col(f"`{category_column}`"), value_column)
    groups = rows.groupBy(F.col("key").alias("category")).agg(
        *_measures("record_count", "total_value", "avg_value"), F.sum("amount").alias("amount")
    )
    share = share_of_total(groups, "amount").alias("value_share_pct")
    return groups.select("category", "record_count", "total_value", "avg_value", share).orderBy(
        F.desc("total_value"), "category"
    )


def entity_summary(df: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """One row per entity, unsorted (there may be billions)."""
    rows = _amounts(df, F.col(f"`{id_column}`"), value_column)
    return rows.groupBy(F.col("key").alias("entity_id")).agg(
        *_measures("transaction_count", "total_value", "avg_value", "min_value", "max_value")
    )


def table_summary(df: DataFrame) -> DataFrame:
    counts = (F.count(F.col(f"`{c}`")).alias(f"{c}_count") for c in df.columns)
    return df.agg(F.count("*").alias("total_rows"), *counts)


def generated_views(
    session_id: str, tables: Mapping[str, DataFrame], types: Mapping[str, Mapping[str, str]]
) -> dict[str, DataFrame]:
    """Temp views ``v_<session>_<table>_<kind>`` for every table, as far as its types allow."""
    out = {}
    for table, df in tables.items():
        kinds = types[table]
        money, dates = _typed(kinds, "currency"), _typed(kinds, "datetime")
        categories, ids = _typed(kinds, "category"), _typed(kinds, "id")
        prefix = f"v_{names.session_prefix(session_id)}_{names.split_prefix(table)[1]}"
        if money:
            value = names.best_hit(money, rules.VIEW_VALUE_HINTS)
            if dates:
                out[f"{prefix}_time_series"] = time_series(df, names.best_hit(dates, rules.VIEW_DATE_HINTS), value)
            if categories:
                out[f"{prefix}_by_category"] = by_category(df, categories[0], value)
            if ids:
                out[f"{prefix}_entity_summary"] = entity_summary(
                    df, names.best_hit(ids, rules.VIEW_ENTITY_HINTS), value
                )
        out[f"{prefix}_summary"] = table_summary(df)
    for name, view in out.items():
        view.createOrReplaceTempView(name)
    return out


def list_views(spark, session_id: str) -> list[str]:
    prefix = f"v_{names.session_prefix(session_id)}"
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
