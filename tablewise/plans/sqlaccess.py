"""Read-only SQL over the session's views. Spark parses and plans the query; the check here
only keeps out what is not a single SELECT."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# fixed values: words a read-only query must not contain
WRITE_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "EXEC", "CALL",
)
COMMENT_MARKS = ("--", "/*", "*/")


def read_only(sql: str | None) -> str:
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("there is no statement")
    if any(mark in text for mark in COMMENT_MARKS):
        raise ValueError("a statement with comments is not run")
    words = re.findall(r"\w+", text.upper())
    if words[:1] != ["SELECT"] or not set(WRITE_WORDS).isdisjoint(words):
        raise ValueError("a statement must begin with SELECT and change nothing")
    if re.search(r";\s*\w", text):
        raise ValueError("one statement at a time")
    return text


def run_query(spark: SparkSession, sql: str, rows: int | None = None) -> DataFrame:
    result = spark.sql(read_only(sql))
    return result if rows is None else result.limit(rows)


def schema_context(spark: SparkSession, session_prefix: str, objects: int | None = None) -> DataFrame:
    """Names and types of the session's tables and views, tables first."""
    listed = sorted(t.name for t in spark.catalog.listTables())
    own = [n for n in listed if n.startswith(session_prefix)]
    own += [n for n in listed if session_prefix in n and n not in own]
    rows = [
        (i, name, f.name, f.dataType.simpleString())
        for i, name in enumerate(own[:objects])
        for f in spark.table(f"`{name}`").schema.fields
    ]
    return spark.createDataFrame(rows, "object_no long, object_name string, column_name string, data_type string")
