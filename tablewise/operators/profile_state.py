"""Profiles that grow with the data: mergeable state per column, so that a new file is read and the old ones are not.

A state holds one row per column: exact counts, ends, sums and lengths, a distinct sketch (HyperLogLog, 2**12 registers: one
standard error is 1.6 %), and as samples the values whose MD5 is smallest, which are the same however the rows were
read. States of parts of a table, put together, are the state of the whole table; they are kept as a table and only small
rows are merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import rules
from tablewise.functions.columns import as_text, is_number, is_text, is_whole, ratio, real, rounded, to_number
from tablewise.session import stage

REGISTERS = 12  # as a power of two
CANDIDATES = 64  # values of a column that are looked at for its samples
STATE = (
    "table_name string, column_name string, column_order int, total_rows bigint, filled bigint, numbers bigint, low double,"
    " high double, total decimal(38,12), longest int, distinct_sketch binary, samples array<struct<mark:string,value:string>>"
)


def _smallest(marked: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(marked)), 1, rules.SAMPLE_VALUES)


def column_state(df: DataFrame, table_name: str) -> DataFrame:
    """The state of every column of one table (or of a part of its rows): one aggregate without a shuffle of rows, then the
    samples, for which its distinct sketches tell how few values need to be looked at."""
    texts, numbers, amounts = [], [], []
    for order, c in enumerate(df.columns):
        kind = df.schema[c].dataType
        number = to_number(F.col(f"`{c}`")) if is_text(kind) else real(F.col(f"`{c}`"), kind) if is_number(kind) else F.lit(None).cast("double")
        texts.append(as_text(df, c).alias(f"t{order}"))
        numbers.append(number.alias(f"n{order}"))
        amount = F.col(f"`{c}`").cast("decimal(20,0)") if is_whole(kind) else number.cast("decimal(28,12)")
        amounts.append(amount.alias(f"a{order}"))
    rows = df.select(*texts, *numbers, *amounts)
    facts = stage(rows.agg(F.array(*(_facts(i, c) for i, c in enumerate(df.columns))).alias("f")).select(F.inline("f")), "profile-facts")
    estimate = F.when(F.col("filled") > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0))
    distinct = {r[0]: r[1] for r in facts.select("column_order", estimate).collect()}
    return facts.join(_samples(rows, distinct), "column_order", "left").select(
        F.lit(table_name).alias("table_name"), "column_name", "column_order", "total_rows", "filled", "numbers", "low", "high",
        F.col("total").cast("decimal(38,12)").alias("total"), "longest", "distinct_sketch", "samples",
    )


def _facts(order: int, name: str) -> Column:
    text, number = F.col(f"t{order}"), F.col(f"n{order}")
    return F.struct(
        F.lit(order).alias("column_order"),
        F.lit(name).alias("column_name"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count(text).alias("filled"),
        F.count(number).alias("numbers"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.sum(f"a{order}").cast("decimal(38,12)").alias("total"),
        F.max(F.length(text)).alias("longest"),
        F.hll_sketch_agg(F.when(text.isNotNull(), F.xxhash64(text)), REGISTERS).alias("distinct_sketch"),
    )


def _mark(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _few(rows: DataFrame, orders: list[int]) -> DataFrame:
    """column_order, mark, text: every value of columns of at most about ``CANDIDATES`` values."""
    sets = rows.agg(F.array(*(F.struct(F.lit(i).alias("column_order"), F.collect_set(f"t{i}").alias("texts")) for i in orders)).alias("s"))
    texts = sets.select(F.inline("s")).select("column_order", F.explode("texts").alias("text"))
    return texts.select("column_order", _mark(F.col("text")).alias("mark"), "text")


def _candidates(rows: DataFrame, shares: dict[int, float]) -> DataFrame:
    """column_order, mark, text: the values whose mark lies in the least share of all marks, once each."""
    marked = rows.select(*(c for i in shares for c in (f"t{i}", _mark(F.col(f"t{i}")).alias(f"m{i}"))))

    def cell(i: int, share: float) -> Column:
        least = F.lit(f"{int(share * 2**64):016x}") if share < 1 else F.lit("g")  # above every mark
        return F.when(F.col(f"m{i}") < least, F.struct(F.lit(i).alias("column_order"), F.col(f"m{i}").alias("mark"), F.col(f"t{i}").alias("text")))

    return marked.select(F.inline(F.array_compact(F.array(*(cell(i, s) for i, s in shares.items()))))).distinct()


def _samples(rows: DataFrame, distinct: dict[int, int]) -> DataFrame:
    """column_order, samples: the values of the smallest marks of every column. Of a column of n values about ``CANDIDATES``
    have marks below the ``CANDIDATES``/n-th of their range, and only these are sent; were there fewer than a sample
    needs, as an estimate may be wrong, more would be."""
    few = [i for i, n in distinct.items() if 0 < n <= CANDIDATES]
    shares = {i: CANDIDATES / n for i, n in distinct.items() if n > CANDIDATES}
    done = [_sampled(_few(rows, few))] if few else []
    while shares:
        found = stage(_sampled(_candidates(rows, shares)), "profile-samples")
        whole = {r[0] for r in found.filter(F.size("samples") == rules.SAMPLE_VALUES).select("column_order").collect()}
        whole |= {i for i, share in shares.items() if share >= 1}
        done.append(found.filter(F.col("column_order").isin(list(whole))))
        shares = {i: min(1.0, share * CANDIDATES) for i, share in shares.items() if i not in whole}
    if not done:
        return rows.sparkSession.createDataFrame([], "column_order int, samples array<struct<mark:string,value:string>>")
    return reduce(lambda a, b: a.unionByName(b), done)


def _sampled(marked: DataFrame) -> DataFrame:
    values = marked.groupBy("column_order", "mark").agg(F.min("text").alias("value"))
    sample = F.array_sort(F.collect_list(F.struct("mark", "value")))
    return values.groupBy("column_order").agg(F.slice(sample, 1, rules.SAMPLE_VALUES).alias("samples"))


def merged(states: DataFrame) -> DataFrame:
    """One state per table and column from the states of parts."""
    samples = F.flatten(F.collect_list("samples"))
    return states.groupBy("table_name", "column_name").agg(
        F.min("column_order").alias("column_order"), F.sum("total_rows").alias("total_rows"), F.sum("filled").alias("filled"),
        F.sum("numbers").alias("numbers"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("total").cast("decimal(38,12)").alias("total"), F.max("longest").alias("longest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), _smallest(samples).alias("samples"),
    )


def add_part(states: DataFrame | None, df: DataFrame, table_name: str) -> DataFrame:
    """The state after another part has come."""
    new = column_state(df, table_name)
    return new if states is None else merged(states.unionByName(new))


def profile_of(states: DataFrame) -> DataFrame:
    """What a state tells: exact figures, and the number of distinct values as an estimate."""
    return states.select(
        "table_name", "column_name", F.col("column_order").cast("long").alias("column_order"), "total_rows",
        (F.col("total_rows") - F.col("filled")).alias("null_count"),
        rounded(ratio((F.col("total_rows") - F.col("filled")) * 100, F.col("total_rows")), 2).cast("double").alias("null_percent"),
        "numbers", "low", "high", rounded(ratio(F.col("total").cast("double"), F.col("numbers")), 4).cast("double").alias("mean"),
        F.col("longest").cast("long").alias("longest"),
        F.when(F.col("filled") > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0)).cast("long").alias("distinct_estimate"),
        F.transform("samples", lambda s: s["value"]).alias("samples"),
    )


def states_of(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [column_state(df, name) for name, df in tables.items()])
