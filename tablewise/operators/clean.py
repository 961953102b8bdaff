"""Cleaning of one table, in the order the steps depend on each other.

The row-level steps are expressions that Spark fuses into one projection. Deduplication is the
only step that shuffles rows; medians, modes and outlier bounds come from aggregates that keep
bounded state, and reach the rows as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import rules
from tablewise.functions.columns import (
    drop_null_tokens,
    is_null_token,
    is_number,
    is_text,
    is_whole,
    real,
    strip_blanks,
    title_case,
    to_flag,
    to_moment,
    to_number,
)
from tablewise.operators.profile import ColumnProfile, types_of
from tablewise.operators.quality import beyond, outlier_bounds
from tablewise.operators.quantiles import REST, exact_quantiles
from tablewise.session import per_table
from tablewise.session import stage as write_stage

Types = Mapping[str, str]

LOG_SCHEMA = (
    "table_name string, seq long, level string, step string, column_name string, affected long,"
    " message string"
)


@dataclass(frozen=True)
class LogEntry:
    level: str
    step: str
    column_name: str | None
    affected: int
    message: str


@dataclass(frozen=True)
class CleanedTable:
    table_name: str
    df: DataFrame
    original_rows: int
    final_rows: int
    duplicate_rows: int
    outlier_columns: int
    log: tuple[LogEntry, ...]
    profile: tuple[ColumnProfile, ...] = ()

    @property
    def rows_removed(self) -> int:
        return self.original_rows - self.final_rows

    def log_frame(self) -> DataFrame:
        rows = [
            (self.table_name, i, e.level, e.step, e.column_name, e.affected, e.message)
            for i, e in enumerate(self.log)
        ]
        return self.df.sparkSession.createDataFrame(rows, LOG_SCHEMA)


def _col(name: str):
    return F.col(f"`{name}`")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def _typed(df: DataFrame, types: Types, *kinds: str) -> list[str]:
    return [c for c in df.columns if types.get(c) in kinds]


def null_tokens(df: DataFrame) -> DataFrame:
    return df.withColumns({c: drop_null_tokens(_col(c)) for c in _text_columns(df)})


def coerce_numbers(df: DataFrame, types: Types) -> DataFrame:
    wanted = [c for c in _typed(df, types, "currency", "numeric") if is_text(df.schema[c].dataType)]
    return df.withColumns({c: to_number(_col(c)) for c in wanted})


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_missing_ids(df: DataFrame, types: Types) -> DataFrame:
    ids = _typed(df, types, "id")
    return df.dropna(subset=ids) if ids else df


def imputation_values(
    df: DataFrame, types: Types, columns: Sequence[str], limit: int = REST
) -> dict[str, object]:
    """Median of numeric columns, most frequent value of text columns (smallest on ties)."""
    numeric = {
        c: real(_col(c), df.schema[c].dataType)
        for c in columns
        if types.get(c) in ("currency", "numeric")
    }
    fills: dict[str, object] = {
        c: q.values[0] for c, q in exact_quantiles(df, numeric, (0.5,), limit).items() if q.count
    }
    texts = [c for c in columns if types.get(c) in ("category", "text")]
    if texts:
        values = df.select(*(_col(c).cast("string").alias(c) for c in texts))
        if len(texts) == 1:
            pairs = values.select(F.lit(texts[0]).alias("c"), _col(texts[0]).alias("v"))
        else:
            pairs = values.unpivot([], [f"`{c}`" for c in texts], "c", "v")
        counts = pairs.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n"))
        modes = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        found = {r["c"]: r["v"] for r in modes.collect()}
        fills |= {c: found.get(c, rules.UNKNOWN_TEXT) for c in texts}
    return fills


def impute(df: DataFrame, types: Types, fills: Mapping[str, object], flags_known: Types | None = None) -> DataFrame:
    """Fill numeric and text columns with the given values and missing flags with False."""
    filled = {}
    for f in df.schema.fields:
        c, kind, value = f.name, types.get(f.name), fills.get(f.name)
        if kind in ("currency", "numeric") and value is not None:
            number = _col(c).cast("double") if is_whole(f.dataType) else _col(c)
            filled[c] = F.coalesce(number, F.lit(value).cast("double"))
        elif kind in ("category", "text") and value is not None:
            filled[c] = F.coalesce(_col(c), F.lit(value))
        elif kind == "boolean":
            if isinstance(f.dataType, T.BooleanType):
                filled[c] = F.coalesce(_col(c), F.lit(False))
            elif (flags_known or {}).get(c, True):
                filled[c] = F.coalesce(to_flag(_col(c)), F.lit(False))
            else:  # values beyond yes/no stay as they are
                filled[c] = F.coalesce(_col(c).cast("string"), F.lit("False"))
    return df.withColumns(filled)


def parse_dates(df: DataFrame, types: Types) -> DataFrame:
    wanted = [c for c in _typed(df, types, "datetime") if is_text(df.schema[c].dataType)]
    return df.withColumns({c: to_moment(_col(c)) for c in wanted})


def strip_text(df: DataFrame) -> DataFrame:
    def stripped(c):
        return F.when(strip_blanks(_col(c)) != "nan", strip_blanks(_col(c)))

    return df.withColumns({c: stripped(c) for c in _text_columns(df)})


def title_categories(df: DataFrame, types: Types) -> DataFrame:
    wanted = [c for c in _typed(df, types, "category") if is_text(df.schema[c].dataType)]
    return df.withColumns({c: title_case(_col(c)) for c in wanted})


def flag_outliers(df: DataFrame, types: Types, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``is_outlier_<column>`` for every numeric column, always present; rows are kept."""
    numeric = [c for c in _typed(df, types, "currency", "numeric") if is_number(df.schema[c].dataType)]
    return df.withColumns(
        {f"is_outlier_{c}": beyond(real(_col(c), df.schema[c].dataType), bounds.get(c)) for c in numeric}
    )


def numeric_columns(df: DataFrame, types: Types) -> list[str]:
    return [c for c in _typed(df, types, "currency", "numeric") if is_number(df.schema[c].dataType)]


def _one_row(df: DataFrame, measures: dict) -> dict:
    keys = list(measures)
    row = df.agg(F.count("*").alias("rows"), *(measures[k].alias(f"m{i}") for i, k in enumerate(keys))).first()
    return {"rows": row["rows"]} | {k: row[f"m{i}"] for i, k in enumerate(keys)}


def clean_table(
    df: DataFrame,
    table_name: str,
    profile: Sequence[ColumnProfile],
    stage: Callable[[DataFrame, str], DataFrame] | None = write_stage,
    limit: int = REST,
    normalise_first: bool = False,
) -> CleanedTable:
    """All steps with their log.

    ``stage`` writes the deduplicated rows to the shared folder, so that the later statistics
    do not repeat the shuffle and an executor can be lost. ``normalise_first`` strips blanks
    and unifies case before duplicates are sought.
    """
    types = types_of(profile)
    flags_known = {p.column_name: p.flags_known for p in profile}
    log: list[LogEntry] = []

    def note(step, column, affected, message, level="action"):
        log.append(LogEntry(level, step, column, int(affected), message))

    # null tokens and numbers stored as text
    texts = _text_columns(df)
    coerced = [c for c in _typed(df, types, "currency", "numeric") if c in texts]
    raw = _one_row(
        df,
        {("token", c): F.count_if(is_null_token(_col(c))) for c in texts}
        | {
            ("lost", c): F.count_if(drop_null_tokens(_col(c)).isNotNull() & to_number(_col(c)).isNull())
            for c in coerced
        },
    )
    original = raw["rows"]
    tokens = sum(raw["token", c] for c in texts)
    if tokens:
        note(
            "null_tokens", None, tokens,
            f"{tokens} placeholders for a missing value became null in {len(texts)} text columns.",
        )
    for c in coerced:
        lost = raw["lost", c]
        note(
            "coerce_numbers", c, lost,
            f"{c}: read as numbers; {lost} values that are none became null." if lost else f"{c}: read as numbers.",
        )
    rows = coerce_numbers(null_tokens(df), types)
    if normalise_first:
        rows = title_categories(strip_text(rows), types)
    rows = drop_duplicates(rows)
    if stage is not None:
        rows = stage(rows, f"dedupe-{table_name}")

    # duplicates, missing ids (each counted among the rows that earlier ids kept) and gaps of
    # the rows that stay, in one pass
    ids = _typed(rows, types, "id")
    kept = [F.lit(True)]
    for c in ids:
        kept.append(kept[-1] & _col(c).isNotNull())
    counted = _one_row(
        rows,
        {"kept": F.count_if(kept[-1])}
        | {("id", c): F.count_if(kept[i] & _col(c).isNull()) for i, c in enumerate(ids)}
        | {("gap", c): F.count_if(kept[-1] & _col(c).isNull()) for c in rows.columns},
    )
    final = counted["kept"]
    duplicates = original - counted["rows"]
    note(
        "duplicates", None, duplicates,
        f"{duplicates} repeated rows removed, one of each kept." if duplicates else "No row is repeated.",
    )
    for c in ids:
        if missing := counted["id", c]:
            note(
                "missing_ids", c, missing,
                f"{c}: {missing} rows without an id removed; they cannot be joined.",
            )
    rows = drop_missing_ids(rows, types)

    # imputation, from statistics of the rows that are left
    gaps = [c for c in rows.columns if counted["gap", c]]
    fills = imputation_values(rows, types, gaps, limit)
    for c in gaps:
        n, kind = counted["gap", c], types.get(c)
        if kind in ("currency", "numeric") and c in fills:
            note("impute", c, n, f"{c}: {n} gaps take the median {fills[c]:.4f}.")
        elif kind in ("category", "text"):
            tail = "'Unknown', as there is no other value." if n == final else f"the most frequent value '{fills[c]}'."
            note("impute", c, n, f"{c}: {n} gaps take {tail}")
        elif kind == "boolean":
            note("impute", c, n, f"{c}: {n} missing flags count as false.")
        elif kind == "datetime":
            note(
                "impute", c, n,
                f"{c}: {n} missing dates stay null; a date is never made up.",
            )
    rows = impute(rows, types, fills, flags_known)

    # dates, blanks and case: counted on the rows just before each step
    dates = _typed(rows, types, "datetime")
    parsed = [c for c in dates if is_text(rows.schema[c].dataType)]
    texts = [c for c in _text_columns(rows) if c not in parsed]
    titled = [c for c in texts if types.get(c) == "category"]
    changed = _one_row(
        rows,
        {("date", c): F.count_if(to_moment(_col(c)).isNull()) for c in parsed}
        | {("strip", c): F.count_if(strip_blanks(_col(c)) != _col(c)) for c in texts}
        | {("title", c): F.count_if(title_case(strip_blanks(_col(c))) != strip_blanks(_col(c))) for c in titled},
    )
    for c in dates:
        if c not in parsed:
            note("dates", c, 0, f"{c}: stored as a date already.")
        elif failed := changed["date", c]:
            note(
                "dates", c, failed,
                f"{c}: {failed} values are no dates and stay null.", "warning",
            )
        else:
            note(
                "dates", c, 0,
                f"{c}: every value read as a date.",
            )
    rows = title_categories(strip_text(parse_dates(rows, types)), types)
    for step, columns, text in (
        ("strip", texts, "Blanks at the ends removed in {n} columns: {names}."),
        ("title", titled, "Letter case made uniform in {n} category columns: {names}."),
    ):
        hit = [c for c in columns if changed[step, c]]
        if hit:
            total = sum(changed[step, c] for c in hit)
            note(step, None, total, text.format(n=len(hit), names=", ".join(hit)))

    # outlier flags
    numeric = numeric_columns(rows, types)
    bounds = outlier_bounds(rows, numeric, limit)
    rows = flag_outliers(rows, types, bounds)
    outside = _one_row(rows, {c: F.count_if(_col(f"is_outlier_{c}")) for c in bounds}) if bounds else {}
    flagged = [c for c in bounds if outside[c]]
    for c in flagged:
        low, high = bounds[c]
        note(
            "outliers", c, outside[c],
            f"{c}: {outside[c]} values beyond {low:.2f} to {high:.2f} are marked in is_outlier_{c}.",
        )
    if not flagged:
        note("outliers", None, 0, "No numeric column has values beyond its bounds.")
    return CleanedTable(
        table_name, rows, original, final, duplicates, len(flagged), tuple(log), tuple(profile)
    )


def clean_tables(
    tables: Mapping[str, DataFrame], profiles: Mapping[str, Sequence[ColumnProfile]], **options
) -> dict[str, CleanedTable]:
    return per_table(lambda name, df: clean_table(df, name, profiles[name], **options), tables)
