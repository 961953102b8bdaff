"""Column expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import rules

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
# fixed values: the characters Unicode text tools strip (Spark's own trim removes spaces only)
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    return F.lower(strip_blanks(c))


def is_null_token(c: Column) -> Column:
    return F.coalesce(folded(c).isin(*rules.NULL_TOKENS), F.lit(False))


def drop_null_tokens(c: Column) -> Column:
    return F.when(~is_null_token(c), c)


def to_number(c: Column) -> Column:
    """Text → double; anything that is not a plain decimal number → null."""
    return F.when(c.rlike(NUMBER_PATTERN), strip_blanks(c).try_cast("double"))


def title_case(c: Column) -> Column:
    """Every run of letters with case starts with a capital, the rest is lower case."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"([{cased}]+|[^{cased}]+)"), 1)

    def capital(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))  # may be two letters, of which one is a capital
        rest = F.lower(F.substring(first, F.lit(2), F.length(first)))
        return F.concat(F.substring(first, 1, 1), rest, F.substring(run, F.lit(2), F.length(run)))

    return F.when(c.isNotNull(), F.array_join(F.transform(runs, capital), ""))


def to_moment(c: Column) -> Column:
    """Text → timestamp. ISO first, then month-first, then day-first where the month would
    exceed 12, then month names and ``yyyyMMdd``; anything else → null.

    One pattern per family of formats picks the only family that is tried on a value.
    """
    text = strip_blanks(c)

    def first_of(value: Column, *formats: str) -> Column:
        return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats))

    slashed = F.translate(text, ".-", "//")
    clock = F.when(
        slashed.contains(" "),
        first_of(
            F.upper(slashed), "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm a",
            "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy h:mm a",
        ),
    ).otherwise(first_of(slashed, "M/d/yyyy", "d/M/yyyy"))
    words = F.regexp_replace(F.translate(text, ",", " "), r"\s+", " ")
    return (
        F.when(c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), text.try_cast("timestamp"))
        .when(c.rlike(r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(\s|$)"), clock)
        .when(
            c.rlike(r"^\s*\d{4}/\d{1,2}/\d{1,2}([ T].*)?$"),
            F.translate(text, "/", "-").try_cast("timestamp"),
        )
        .when(
            c.rlike(r"^\s*(\p{L}{3,},? \d{1,2},?|\d{1,2},? \p{L}{3,},?) +\d{4}\s*$"),
            first_of(words, "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy"),
        )
        .when(c.rlike(r"^\s*\d{8}\s*$"), first_of(text, "yyyyMMdd"))
    )


def to_flag(c: Column) -> Column:
    """yes/true/y/1/t → true, no/false/n/0/f → false, else null."""
    value = folded(c.cast("string"))
    return F.when(value.isin(*(s[0] for s in rules.BOOLEAN_SETS)), F.lit(True)).when(
        value.isin(*(s[1] for s in rules.BOOLEAN_SETS)), F.lit(False)
    )


def moment_literal(value: dt.datetime | dt.date) -> Column:
    """A zone-free timestamp literal, whatever the time zones of Python and the session are. As
    a literal it reaches the Parquet reader and skips row groups."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_moment(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def as_text(df: DataFrame, name: str) -> Column:
    """Text form that is equal exactly where the values are equal (0.0 and -0.0 are)."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.FractionalType):
        c = c + F.lit(0)
    return c.cast("string")


def row_digest(df: DataFrame) -> Column:
    """The SHA-256 of a row: equal exactly where all values are equal (nulls too). Each value's text goes in with
    its length in front, so that no two rows give the same text."""
    parts = []
    for c in df.columns:
        text = as_text(df, c)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def row_hash(df: DataFrame) -> Column:
    """64 bits that are equal where all values are (nulls and their places too); seldom elsewhere."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`") if isinstance(f.dataType, T.AtomicType) else as_text(df, f.name)
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def real(c: Column, t: T.DataType) -> Column:
    """A numeric column as double with NaN read as missing; text is coerced."""
    if is_text(t):
        return to_number(c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


AMOUNT = "decimal(38,12)"


def exact_amount(c: Column, t: T.DataType) -> Column:
    """Money as a decimal: sums are exact and do not depend on the order of rows.

    Doubles count as the decimal of their shortest text, to twelve places and below 1e26; larger
    ones are an error, not a wrong sum."""
    if isinstance(t, T.DecimalType):
        return c
    if isinstance(t, T.IntegralType):
        return c.cast("decimal(20,0)")
    return real(c, t).cast(AMOUNT)


def rounded(c: Column, digits: int) -> Column:
    """Round half away from zero on a decimal, as SQL ``ROUND(x::numeric, n)`` does."""
    return F.round(c.cast("decimal(28,6)"), digits)


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0)))


def percent_change(current: Column, previous: Column) -> Column:
    """Change relative to the size of the previous value; null where that is zero."""
    return F.try_divide(current - previous, F.nullif(F.abs(previous), F.lit(0.0))) * 100


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two moments, cut towards zero."""
    return F.extract(F.lit("DAY"), later - earlier).cast("long")


def month_of(c: Column) -> Column:
    return F.date_trunc("month", c).cast("timestamp_ntz")


def templated_path(c: Column) -> Column:
    return F.regexp_replace(c, rules.DYNAMIC_PATH, "/:id")


def duration_bucket(seconds: Column) -> Column:
    (first, first_name), (second, second_name) = rules.DURATION_BUCKETS
    return (
        F.when(seconds <= first, F.lit(first_name))
        .when(seconds <= second, F.lit(second_name))
        .otherwise(F.lit(rules.DURATION_OVER))
    )


def grouped_number(c: Column, digits: int = 2) -> Column:
    """``1234.5`` → ``1,234.50``."""
    return F.format_number(c.cast("decimal(28,6)"), digits)


def one_place(value: Column) -> Column:
    """``1234.56`` → ``1234.6``: the double's exact value decides, so 0.85 (a little less) gives 0.8."""
    return F.regexp_replace(F.format_number(value, 1), ",", "")


def display_value(value: Column, unit: Column) -> Column:
    """Text shown on a metric card, by unit."""
    number = F.format_number(value, 2)
    return (
        F.when(unit == "currency", F.concat(F.lit("$"), number))
        .when(unit == "count", F.format_number(value, 0))
        .when(unit == "percent", F.concat(one_place(value), F.lit("%")))
        .when(unit == "days", F.concat(F.regexp_replace(F.format_number(value, 0), ",", ""), F.lit(" days")))
        .otherwise(number)
    )


def compact_value(value: Column) -> Column:
    """``1.2K``, ``3.4M``, ``5.6B`` for large numbers."""
    size = F.abs(value)

    def scaled(by: float, suffix: str) -> Column:
        return F.concat(one_place(value / by), F.lit(suffix))

    return (
        F.when(size >= 1e9, scaled(1e9, "B"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "K"))
        .otherwise(F.format_number(value, 2))
    )


def file_size_text(size: Column) -> Column:
    return (
        F.when(size.isNull() | (size == 0), F.lit("-"))
        .when(size < 1024 * 1024, F.concat(F.format_number(size / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(" MB")))
    )
