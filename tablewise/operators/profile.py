"""Column profiles and semantic types.

The columns of one type are turned into (place of the column, value) pairs and counted once: distinct pairs,
pre-combined on the map side, are all that is shuffled, and nulls, distinct counts, number and
date shares and the type rules follow from them. A hot value is one pair per map task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import names, rules
from tablewise.functions.columns import (
    WHOLE_PATTERN,
    as_text,
    folded,
    is_moment,
    is_number,
    is_text,
    is_whole,
    ratio,
    real,
    rounded,
    to_moment,
    to_number,
)

NAME_FACTS = (
    "map<string, struct<column_order: bigint, stored_as: string, date_word: boolean,"
    " id_word: boolean, currency_word: boolean, flag_name: boolean>>"
)
# measures only some kinds of columns have; null for the others
TEXT_FACTS = {
    "numbers": "bigint", "low": "double", "high": "double", "mean": "double", "has_fraction": "boolean",
    "whole_texts": "bigint", "moments": "bigint", "outside_all": "bigint",
} | {f"outside_{i}": "bigint" for i in range(len(rules.BOOLEAN_SETS))}
LONG_TEXT = 200
NUMBER_LIKE = r"^[\s$€£,.0-9eE+-]*$"
HEAD_ROWS = 200


@dataclass(frozen=True)
class ColumnProfile:
    column_name: str
    detected_type: str
    null_count: int
    null_percent: float
    unique_count: int
    sample_values: tuple[str, ...]
    column_order: int
    total_rows: int
    stored_as: str
    mixed: bool
    flags_known: bool

    def storage_row(self) -> dict:
        return asdict(self)


PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("detected_type", T.StringType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_percent", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
        T.StructField("column_order", T.LongType()),
    ]
)


def stored_as(t: T.DataType) -> str:
    if is_text(t):
        return "text"
    if isinstance(t, T.BooleanType):
        return "flag"
    if is_moment(t):
        return "moment"
    if is_whole(t):
        return "whole"
    return "real" if is_number(t) else "other"


def comparable_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly where the values are; a long text is represented by the
    SHA-256 of the whole of it, so shuffles stay narrow. Padding does not make a text long, and what
    may be a number stays as it is."""
    text = as_text(df, name)
    if stored_as(df.schema[name].dataType) not in ("text", "other"):
        return text
    padded = F.length(text) > LONG_TEXT
    long = padded & (F.length(F.btrim(text, F.lit(" \t\n\r\f\v"))) > LONG_TEXT) & ~text.rlike(NUMBER_LIKE)
    return F.when(long, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def _counted(values: DataFrame) -> DataFrame:
    """(place, value, n) for every distinct value of every column of one type, null included. A place is the number of a
    column: as narrow a key as there is."""
    cells = [F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(values.columns)]
    return values.select(F.inline(F.array(*cells))).groupBy("place", "value").agg(F.count("*").alias("n"))


def _named(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    name = F.get(F.array(*map(F.lit, columns)), F.col("place"))
    return counted.select(name.alias("column_name"), *(c for c in counted.columns if c != "place"))


def value_counts(values: DataFrame) -> DataFrame:
    """(column_name, value, n) for every distinct value of every column of one type, null
    included."""
    return _named(_counted(values), values.columns)


def _weight(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))


def _counts() -> list[Column]:
    return [
        F.sum("n").alias("total_rows"),
        _weight(F.col("value").isNotNull()).alias("filled"),
        F.count("value").alias("unique_count"),
    ]


def _number_facts(number: Column) -> list[Column]:
    filled = F.when(number.isNotNull(), F.col("n"))
    return [
        F.coalesce(F.sum(filled), F.lit(0)).alias("numbers"),
        F.min(number).cast("double").alias("low"),
        F.max(number).cast("double").alias("high"),
        ratio(F.sum(number.cast("double") * F.col("n")), F.sum(filled)).alias("mean"),
        F.coalesce(F.bool_or(number.cast("double") % 1 != 0), F.lit(False)).alias("has_fraction"),
    ]


def _number_stats(values: DataFrame) -> DataFrame:
    stats = _counted(values).groupBy("place").agg(*_counts(), *_number_facts(F.col("value")))
    return _named(stats, values.columns)


def _value_stats(values: DataFrame) -> DataFrame:
    return _named(_counted(values).groupBy("place").agg(*_counts()), values.columns)


def _text_stats(values: DataFrame) -> DataFrame:
    value = F.col("value")
    every_flag = [w for pair in rules.BOOLEAN_SETS for w in pair]
    read = _counted(values).select(
        "*",
        to_number(value).alias("number"),
        to_moment(value).alias("moment"),
        folded(value).alias("word"),
        value.rlike(WHOLE_PATTERN).alias("is_whole"),
    )
    word = F.col("word")
    stats = read.groupBy("place").agg(
        *_counts(),
        *_number_facts(F.col("number")),
        _weight(F.col("is_whole")).alias("whole_texts"),
        _weight(F.col("moment").isNotNull()).alias("moments"),
        *(
            _weight(word.isNotNull() & ~word.isin(*pair)).alias(f"outside_{i}")
            for i, pair in enumerate(rules.BOOLEAN_SETS)
        ),
        _weight(word.isNotNull() & ~word.isin(*every_flag)).alias("outside_all"),
    )
    return _named(stats, values.columns)


def column_stats(df: DataFrame, match: str = "substring") -> DataFrame:
    """One row per column: counts, shares and the name flags the type rules read.

    Columns are counted by type, each type in one pass over its own columns, so numbers are
    never turned into text and back."""
    kinds = {f.name: stored_as(f.dataType) for f in df.schema.fields}

    def typed(names_, convert) -> DataFrame:
        return df.select(*(convert(c).alias(c) for c in names_))

    def number(c):
        return real(F.col(f"`{c}`"), df.schema[c].dataType)

    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    floats = [c for c, k in kinds.items() if k == "real" and c not in decimals]
    wholes = [c for c, k in kinds.items() if k == "whole"]
    texts = [c for c, k in kinds.items() if k == "text"]
    moments = [c for c, k in kinds.items() if k == "moment"]
    rest = [c for c, k in kinds.items() if k in ("flag", "other")]
    frames = []
    if wholes:
        frames.append(_number_stats(typed(wholes, lambda c: F.col(f"`{c}`").cast("long"))))
    if floats:
        frames.append(_number_stats(typed(floats, number)))
    for kind in sorted({df.schema[c].dataType.simpleString() for c in decimals}):
        same = [c for c in decimals if df.schema[c].dataType.simpleString() == kind]
        frames.append(_number_stats(typed(same, lambda c: F.col(f"`{c}`"))))
    if texts:
        frames.append(_text_stats(typed(texts, lambda c: comparable_text(df, c))))
    for kind in sorted({df.schema[c].dataType.simpleString() for c in moments}):
        same = [c for c in moments if df.schema[c].dataType.simpleString() == kind]
        frames.append(_value_stats(typed(same, lambda c: F.col(f"`{c}`"))))
    if rest:
        frames.append(_value_stats(typed(rest, lambda c: comparable_text(df, c))))
    stats = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    absent = {c: t for c, t in TEXT_FACTS.items() if c not in stats.columns}
    stats = stats.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()})
    facts = {
        c: {
            "column_order": order,
            "stored_as": kinds[c],
            "date_word": names.has_keyword(c, rules.DATE_WORDS, match),
            "id_word": names.has_keyword(c, rules.ID_WORDS, match),
            "currency_word": names.has_keyword(c, rules.CURRENCY_WORDS, match),
            "flag_name": c.strip().lower().startswith(rules.BOOLEAN_PREFIXES),
        }
        for order, c in enumerate(df.columns)
    }
    meta = F.from_json(F.lit(json.dumps(facts)), NAME_FACTS)
    return stats.select("*", F.element_at(meta, F.col("column_name")).alias("m")).select("*", "m.*").drop("m")


def _numeric_type(whole: Column) -> Column:
    """id, currency or numeric, for a column whose values are numbers."""
    unique, filled = F.col("unique_count"), F.col("filled")
    spread = F.col("high") - F.col("low") + 1
    running_number = (
        (unique == filled)
        & F.col("low").isin(0.0, 1.0)
        & ((spread - filled) <= spread * rules.SEQUENCE_MAX_GAP)
    )
    keyed = F.col("id_word") & (F.col("share_unique") >= rules.ID_MIN_RATIO)
    return (
        F.when(whole & (keyed | running_number), "id")
        .when(F.col("currency_word"), "currency")
        .when(~whole & F.col("has_fraction") & (F.col("mean") > 1) & (F.col("high") > 1), "currency")
        .otherwise("numeric")
    )


def with_semantic_type(stats: DataFrame) -> DataFrame:
    """The type rules over the rows of :func:`column_stats`, first match wins."""
    kind, filled, unique = F.col("stored_as"), F.col("filled"), F.col("unique_count")
    share_unique = F.col("share_unique")
    text = kind == "text"
    one_boolean_set = F.least(*(F.col(f"outside_{i}") for i in range(len(rules.BOOLEAN_SETS)))) == 0
    zero_one = (kind == "whole") & (F.col("low") >= 0) & (F.col("high") <= 1)
    enough = text & (filled >= rules.DATE_MIN_VALUES)
    numeric_text = text & (F.col("numbers") >= filled * rules.NUMERIC_TEXT_MIN_SHARE)
    keyed_text = F.col("id_word") & (
        (share_unique >= rules.ID_MIN_RATIO)
        | ((unique >= rules.ID_KEYWORD_MIN_UNIQUE) & (share_unique >= rules.ID_KEYWORD_MIN_RATIO))
    )
    bare_key = (share_unique >= rules.ID_BARE_MIN_RATIO) & (unique > rules.ID_BARE_MIN_UNIQUE)
    whole = (kind == "whole") | (text & (F.col("whole_texts") == filled))
    facts = (
        stats.withColumn("share_unique", ratio(unique, F.col("total_rows")))
        .withColumn("dates", enough & (F.col("moments") >= filled * rules.DATE_MIN_SHARE))
        .withColumn("numeric_type", _numeric_type(whole))
    )
    decided = (
        F.when(filled == 0, "text")
        .when((kind == "flag") | F.col("flag_name") | zero_one | (text & one_boolean_set), "boolean")
        .when((kind == "moment") | (F.col("date_word") & F.col("dates")), "datetime")
        .when(kind.isin("whole", "real") | numeric_text, F.col("numeric_type"))
        .when(F.col("dates"), "datetime")
        .when(keyed_text | bare_key, "id")
        .when(
            (share_unique <= rules.CATEGORY_MAX_RATIO) | (unique <= rules.CATEGORY_MAX_UNIQUE), "category"
        )
        .otherwise("text")
    )
    return facts.withColumn("detected_type", decided)


def profile_frame(df: DataFrame, table_name: str, match: str = "substring") -> DataFrame:
    """Lazy profile: one row per column with counts and the semantic type."""
    nulls = F.col("total_rows") - F.col("filled")
    return with_semantic_type(column_stats(df, match)).select(
        F.lit(table_name).alias("table_name"),
        "column_name",
        "detected_type",
        nulls.alias("null_count"),
        rounded(F.coalesce(ratio(nulls, F.col("total_rows")) * 100, F.lit(0.0)), 2)
        .cast("double")
        .alias("null_percent"),
        "unique_count",
        "column_order",
        "total_rows",
        "stored_as",
        ((F.col("stored_as") == "text") & (F.col("numbers") < F.col("filled"))).alias("mixed"),
        (F.coalesce("outside_all", F.lit(0)) == 0).alias("flags_known"),
    )


def sample_values(df: DataFrame) -> dict[str, tuple[str, ...]]:
    """Up to five non-null values per column from the head of the table; columns empty there
    are looked up one by one (``take`` stops at the first partitions that have values)."""
    head = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).take(HEAD_ROWS)
    out = {}
    for i, c in enumerate(df.columns):
        found = [r[i] for r in head if r[i] is not None][: rules.SAMPLE_VALUES]
        if len(found) < rules.SAMPLE_VALUES and len(head) == HEAD_ROWS:
            filled = df.filter(F.col(f"`{c}`").isNotNull())
            found = [r[0] for r in filled.select(F.col(f"`{c}`").cast("string")).take(rules.SAMPLE_VALUES)]
        out[c] = tuple(found)
    return out


def profile_table(
    df: DataFrame, table_name: str, match: str = "substring", samples: bool = True
) -> list[ColumnProfile]:
    """The profile as driver-side metadata: one entry per column."""
    rows = {r["column_name"]: r for r in profile_frame(df, table_name, match).collect()}
    picked = sample_values(df) if samples else {}
    out = []
    for order, c in enumerate(df.columns):
        r = rows.get(c)
        if r is None:  # a table without rows
            kind = stored_as(df.schema[c].dataType)
            out.append(ColumnProfile(c, "text", 0, 0.0, 0, (), order, 0, kind, False, True))
            continue
        out.append(
            ColumnProfile(
                c, r["detected_type"], r["null_count"], r["null_percent"], r["unique_count"],
                picked.get(c, ()), order, r["total_rows"], r["stored_as"], r["mixed"], r["flags_known"],
            )
        )
    return out


def number_candidates(df: DataFrame) -> list[str]:
    """Columns that may be numeric or currency: numbers, and texts of which 95 % of the filled ones are numbers. One pass
    that shuffles no values, so long texts cost their reading alone."""
    kinds = {f.name: stored_as(f.dataType) for f in df.schema.fields}
    texts = [c for c, k in kinds.items() if k == "text"]
    counts = [F.count(F.col(f"`{c}`")) for c in texts] + [F.count(to_number(F.col(f"`{c}`"))) for c in texts]
    found = list(df.agg(*counts).first()) if texts else []
    likely = {c for c, filled, numbers in zip(texts, found, found[len(texts):]) if filled and numbers >= rules.NUMERIC_TEXT_MIN_SHARE * filled}
    return [c for c, k in kinds.items() if k in ("whole", "real") or c in likely]


def types_of(profile: Sequence[ColumnProfile]) -> dict[str, str]:
    return {p.column_name: p.detected_type for p in profile}


def profiles_to_frame(spark, profiles: dict[str, Sequence[ColumnProfile]]) -> DataFrame:
    rows = [
        (
            table, p.column_name, p.detected_type, p.null_count, p.null_percent, p.unique_count,
            list(p.sample_values), p.column_order,
        )
        for table, columns in profiles.items()
        for p in columns
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def dataset_summary(profiles: DataFrame, quality: DataFrame) -> DataFrame:
    """Tables, fields, rows, completeness and mean score of a session."""
    fields = profiles.agg(
        F.count("*").alias("v"), F.avg("null_percent").alias("null_percent")
    )
    return quality.agg(
        F.count("*").alias("tables"),
        fields.select("v").scalar().alias("fields"),
        F.sum("total_rows").alias("total_rows"),
        rounded(100 - fields.select("null_percent").scalar(), 2).cast("double").alias("completeness"),
        F.floor(F.avg("quality_score")).cast("long").alias("overall_quality"),
    )


def search_fields(profiles: DataFrame, query: str) -> DataFrame:
    haystack = F.lower(F.concat_ws(" ", "table_name", "column_name", "detected_type"))
    return profiles.filter(haystack.contains(query.strip().lower()))


def nested_schema(profiles: DataFrame, quality: DataFrame | None = None, relationships: DataFrame | None = None) -> DataFrame:
    """One row per table with its ordered columns as an array of structs (metadata-sized), with its quality report and with the
    relationships that it has on either side, where these are given."""
    column = F.struct(
        "column_order", "column_name", "detected_type", "null_count", "null_percent",
        "unique_count", *(["sample_values"] if "sample_values" in profiles.columns else []),
    )
    nested = profiles.groupBy("table_name").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    if quality is not None:
        report = F.struct(*(c for c in quality.columns if c not in ("table_name", "session_id")))
        nested = nested.join(quality.select("table_name", report.alias("quality")), "table_name", "left")
    if relationships is not None:
        link = F.struct("from_table", "from_column", "to_table", "to_column", "confidence", "match_percent")
        sides = F.explode(F.array_distinct(F.array("from_table", "to_table"))).alias("table_name")
        links = relationships.select(sides, link.alias("link")).groupBy("table_name").agg(F.sort_array(F.collect_list("link")).alias("links"))
        nested = nested.join(links, "table_name", "left")
        none = F.array().cast(links.schema["links"].dataType)
        nested = nested.withColumn("links", F.coalesce("links", none)).withColumnRenamed("links", "relationships")
    return nested


def filter_values(df: DataFrame, table_name: str, profile: Sequence[ColumnProfile]) -> DataFrame:
    """(table, column, value) for every value of every category column, however many there are."""
    names = [p.column_name for p in profile if p.detected_type == "category"]
    if not names:
        return df.sparkSession.createDataFrame([], "`table` string, `column` string, value string")
    texts = df.select(*(as_text(df, c).alias(c) for c in names))
    found = value_counts(texts).filter("value is not null")
    return found.select(F.lit(table_name).alias("table"), F.col("column_name").alias("column"), "value")


def filter_fields(df: DataFrame, table_name: str, profile: Sequence[ColumnProfile]) -> DataFrame:
    """Fields a dashboard can filter on: the date range of every datetime column and the
    sorted values of every small category, in one aggregate pass. A category of more values has null
    for its values; ``filter_values`` lists them."""
    dates = [p.column_name for p in profile if p.detected_type == "datetime"]
    categories = [p for p in profile if p.detected_type == "category"]
    small = [p.column_name for p in categories if p.unique_count <= rules.CATEGORY_MAX_UNIQUE]
    entries, measures = [], []
    empty = F.array().cast("array<string>")

    def entry(column, kind, low, high, values):
        return F.struct(
            F.lit(column).alias("column"), F.lit(kind).alias("type"), low.alias("min"),
            high.alias("max"), values.alias("values"),
        )

    for i, c in enumerate(dates):
        moment = F.col(f"`{c}`")
        if is_text(df.schema[c].dataType):
            moment = to_moment(moment)
        measures += [F.min(moment).alias(f"lo{i}"), F.max(moment).alias(f"hi{i}")]
        entries.append(
            entry(c, "date", F.to_date(f"lo{i}").cast("string"), F.to_date(f"hi{i}").cast("string"), empty)
        )
    nothing = F.lit(None).cast("string")
    for i, c in enumerate(small):
        # at most 50 distinct values, known from the profile
        measures.append(F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"vs{i}"))
        entries.append(entry(c, "category", nothing, nothing, F.col(f"vs{i}")))
    for p in categories:
        if p.column_name not in small:
            entries.append(entry(p.column_name, "category", nothing, nothing, F.lit(None).cast("array<string>")))
    if not entries:
        schema = "`table` string, `column` string, type string, min string, max string, values array<string>"
        return df.sparkSession.createDataFrame([], schema)
    found = df.agg(*(measures or [F.count(F.lit(1))])).select(F.inline(F.array(*entries)))
    usable = (F.col("type") == "category") | F.col("min").isNotNull()
    return found.filter(usable).select(F.lit(table_name).alias("table"), "*")
