"""Quality score of a raw table: duplicates, nulls, outliers and mixed types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import rules
from tablewise.functions.columns import one_place, ratio, real, row_digest, row_hash
from tablewise.operators.profile import ColumnProfile
from tablewise.operators.quantiles import REST, exact_quantiles
from tablewise.session import stage

COLUMN_SCHEMA = T.StructType(
    [
        T.StructField("column_order", T.LongType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("detected_type", T.StringType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_percent", T.DoubleType()),
        T.StructField("mixed", T.BooleanType()),
        T.StructField("outlier_count", T.LongType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("duplicate_rows", T.LongType()),
    ]
)


FEW_HASHES = 1_000_000  # eight megabytes, which a join sends to every task


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (nulls equal), as one row.

    A row whose 64-bit hash no other row has is alone. The others, or all where many hashes repeat, travel as one
    digest each, whatever they hold; partial counts collapse hot rows before the shuffle.
    """
    hashes = df.select(row_hash(df).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    repeated = stage(hashes.filter("n > 1").select("hash"), "row-hashes")
    suspects = df
    if repeated.count() <= FEW_HASHES:
        hashed = df.select("*", row_hash(df).alias("__hash"))
        suspects = hashed.join(repeated, hashed["__hash"] == repeated["hash"], "left_semi")
    groups = suspects.select(row_digest(df).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    extra = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    return df.agg(F.count("*").alias("total_rows")).select("total_rows", extra.scalar().alias("duplicate_rows"))


def outlier_bounds(
    df: DataFrame, columns: Sequence[str], limit: int = REST
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column; columns with too few values or no spread have none."""
    numbers = {c: real(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    bounds = {}
    for c, q in exact_quantiles(df, numbers, (0.25, 0.75), limit).items():
        if q.count < rules.OUTLIER_MIN_VALUES:
            continue
        q1, q3 = q.values
        reach = rules.OUTLIER_SPREAD * (q3 - q1)
        if reach != 0:
            bounds[c] = (q1 - reach, q3 + reach)
    return bounds


def beyond(value: Column, bounds: tuple[float, float] | None) -> Column:
    """Is the value outside its bounds? Null, or no bounds, is False."""
    if bounds is None:
        return F.lit(False)
    return F.coalesce((value < bounds[0]) | (value > bounds[1]), F.lit(False))


def count_outliers(
    df: DataFrame, columns: Sequence[str], limit: int = REST
) -> dict[str, int]:
    bounds = outlier_bounds(df, columns, limit)
    if not bounds:
        return {c: 0 for c in columns}
    tests = [
        F.count_if(beyond(real(F.col(f"`{c}`"), df.schema[c].dataType), b)).alias(f"o{i}")
        for i, (c, b) in enumerate(bounds.items())
    ]
    row = df.agg(*tests).first()
    return {c: 0 for c in columns} | dict(zip(bounds, row))


def measure(df: DataFrame, profile: Sequence[ColumnProfile], limit: int = REST) -> DataFrame:
    """One metadata row per column with everything the score needs."""
    numeric = [p.column_name for p in profile if p.detected_type in ("numeric", "currency")]
    outliers = count_outliers(df, numeric, limit)
    total, duplicates = duplicate_count(df).first()
    rows = [
        (
            p.column_order, p.column_name, p.detected_type, p.null_count, p.null_percent,
            p.mixed and p.detected_type in ("numeric", "currency"), int(outliers.get(p.column_name, 0)),
            total, duplicates,
        )
        for p in profile
    ]
    return df.sparkSession.createDataFrame(rows, COLUMN_SCHEMA)


def issue_rows(measured: DataFrame) -> DataFrame:
    """One row per finding: (check_order, column_order, column_name, issue_type, severity,
    description, action, points)."""
    name, share = F.col("column_name"), F.col("null_percent") / 100
    imputation = F.create_map(*(F.lit(x) for kv in rules.IMPUTATION_TEXT.items() for x in kv))

    def issue(order, kind, severity, text, action, points) -> Column:
        return F.struct(
            F.lit(order).alias("check_order"), F.lit(kind).alias("issue_type"), severity.alias("severity"),
            text.alias("description"), action.alias("action"), points.cast("int").alias("points"),
        )

    warning = F.lit("warning")
    checks = F.array(
        F.when(
            share == 1.0,
            issue(
                2, "all_null", F.lit("critical"),
                F.format_string("%s holds no value at all", name),
                F.format_string("%s: cleaning writes 'Unknown'", name),
                F.lit(rules.POINTS_MANY_NULLS),
            ),
        ),
        F.when(
            (share > rules.NULLS_WARNING) & (share < 1.0),
            issue(
                2, "nulls",
                F.when(share > rules.NULLS_CRITICAL, F.lit("critical")).otherwise(warning),
                F.format_string("%s lacks %d values (%s%%)", name, "null_count", one_place(F.col("null_percent"))),
                F.format_string("%s: %s", name, F.element_at(imputation, F.col("detected_type"))),
                F.lit(rules.POINTS_NULL_COLUMN)
                + F.when(share > rules.NULLS_CRITICAL, rules.POINTS_MANY_NULLS).otherwise(0),
            ),
        ),
        F.when(
            F.col("outlier_count") > 0,
            issue(
                3, "outliers", warning,
                F.format_string(
                    "%s holds %d extreme values (%s%%)", name, "outlier_count",
                    one_place(ratio(F.col("outlier_count") * 100, F.col("total_rows"))),
                ),
                F.format_string(
                    "%s: cleaning marks them in is_outlier_%s and keeps them", name, name,
                ),
                F.lit(rules.POINTS_OUTLIERS),
            ),
        ),
        F.when(
            F.col("mixed"),
            issue(
                4, "mixed_types", warning,
                F.format_string(
                    "%s mixes numbers with other text", name,
                ),
                F.format_string(
                    "%s: cleaning reads the numbers and fills the rest", name
                ),
                F.lit(rules.POINTS_MIXED_TYPE),
            ),
        ),
    )
    found = measured.select("column_order", "column_name", F.explode(F.array_compact(checks)).alias("i"))
    columns = found.select(
        "i.check_order", "column_order", "column_name", "i.issue_type", "i.severity", "i.description",
        "i.action", "i.points",
    )
    extra = F.col("duplicate_rows")
    share_extra = ratio(extra, F.col("total_rows"))
    table = (
        measured.filter((F.col("column_order") == 0) & (extra > 0))
        .select(
            F.lit(1).alias("check_order"),
            F.lit(-1).cast("long").alias("column_order"),
            F.lit(None).cast("string").alias("column_name"),
            F.lit("duplicates").alias("issue_type"),
            warning.alias("severity"),
            F.format_string("%d rows repeat others (%s%%)", extra, one_place(ratio(extra * 100, F.col("total_rows")))).alias("description"),
            F.format_string("Cleaning removes %d repeated rows", extra).alias("action"),
            F.when(share_extra > rules.DUPLICATES_LIMIT, rules.POINTS_DUPLICATES).otherwise(0).alias("points"),
        )
    )
    return table.unionByName(columns)


def level_of(score: Column) -> Column:
    level = F.lit(rules.QUALITY_LEVELS[-1][1])
    for least, name in reversed(rules.QUALITY_LEVELS[:-1]):
        level = F.when(score >= least, F.lit(name)).otherwise(level)
    return level


def summary_text(score: Column, duplicates: Column, null_columns: Column, outlier_columns: Column) -> Column:
    head = F.format_string("Quality: %s, %d of 100 points. ", level_of(score), score)
    parts = F.concat_ws(
        ", ",
        F.when(duplicates > 0, F.format_string("%d repeated rows", duplicates)),
        F.when(null_columns > 0, F.format_string("%d columns with gaps", null_columns)),
        F.when(outlier_columns > 0, F.format_string("%d columns with extreme values", outlier_columns)),
    )
    return F.concat(
        head,
        F.when(parts == "", F.lit("Nothing was found.")).otherwise(
            F.concat(
                F.lit("Found: "), parts, F.lit(". Cleaning takes care of them.")
            )
        ),
    )


def quality_report(
    df: DataFrame, table_name: str, profile: Sequence[ColumnProfile], limit: int = REST
) -> DataFrame:
    """One row: score, counts, ordered lists of findings and actions, and a summary."""
    measured = measure(df, profile, limit)
    issues = issue_rows(measured)
    ordered = F.sort_array(
        F.collect_list(
            F.struct(
                "check_order", "column_order", "column_name", "issue_type", "severity", "description",
                "action", "points",
            )
        )
    )
    kinds = F.transform("found", lambda i: i["issue_type"])
    score = F.greatest(
        F.lit(0),
        F.lit(100) - F.aggregate("found", F.lit(0), lambda total, i: total + i["points"]),
    )
    scored = measured.agg(
        F.first("total_rows").alias("total_rows"),
        F.count("*").alias("total_columns"),
        F.first("duplicate_rows").alias("duplicate_rows"),
    ).withColumn("found", issues.agg(ordered.alias("found")).scalar()).select(
        F.lit(table_name).alias("table_name"),
        score.cast("long").alias("quality_score"),
        "total_rows",
        "total_columns",
        "duplicate_rows",
        F.size(F.filter(kinds, lambda k: k.isin("nulls", "all_null"))).cast("long").alias("columns_with_nulls"),
        F.size(F.filter(kinds, lambda k: k == "outliers")).cast("long").alias("outlier_columns"),
        F.transform("found", lambda i: i["description"]).alias("issues_found"),
        F.transform("found", lambda i: i["action"]).alias("actions_taken"),
        F.filter("found", lambda i: i["column_name"].isNotNull()).alias("column_issues"),
    )
    return scored.withColumn(
        "summary",
        summary_text(
            F.col("quality_score"), F.col("duplicate_rows"), F.col("columns_with_nulls"), F.col("outlier_columns")
        ),
    )


def storage_row(report: DataFrame, session_id: str) -> DataFrame:
    return report.select(
        F.lit(session_id).alias("session_id"), "table_name", "quality_score", "total_rows", "duplicate_rows",
        "columns_with_nulls", "outlier_columns", "issues_found", "actions_taken",
    )


def outlier_notice(reports: DataFrame) -> DataFrame:
    """One notice naming every table with outlier columns; no row when there is none."""
    part = F.format_string("%s (%d column(s))", F.col("table_name"), F.col("outlier_columns"))
    affected = reports.filter(F.col("outlier_columns") > 0).agg(
        F.sort_array(F.collect_list(F.struct("table_name", part.alias("part")))).alias("parts")
    )
    return affected.filter(F.size("parts") > 0).select(
        F.lit("anomaly_detected").alias("event_type"),
        F.lit("Anomalies detected").alias("title"),
        F.concat(
            F.lit("Values far from the rest were marked in "),
            F.array_join(F.transform("parts", lambda p: p["part"]), ", "),
            F.lit("."),
        ).alias("message"),
    )
