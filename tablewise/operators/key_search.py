"""Which key columns hold the values of which others, over thousands of columns, names left aside.

1. One shuffle gives each distinct value once, with the columns that hold it as a bit mask; all further steps read that.
2. Of each column some values of smallest hash, ``SKETCH`` or a few times as many, are a random sample of its values, the whole
   column if it is small. Their masks tell how much of the sample each other column holds.
3. A pair is discarded if its count is so low that a share of ``least`` would give it with a chance under 10**-9 (Hoeffding's
   bound); a small column's count is exact.
4. For the pairs left, shared values are counted exactly from the number of values that have the same mask.

Nothing is written per pair on the driver: pairs are rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ratio, strip_blanks
from tablewise.session import stage

SKETCH = 256
MISS = 1e-9
BITS = 63  # columns to a word of a mask


def values_with_keys(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """value, mask words k0, k1, ...: each distinct value once; bit i of word w stands for column ``BITS`` * w + i, in order."""
    width, key, frames = -(-sum(map(len, columns.values())) // BITS), 0, []
    words = [f"k{w}" for w in range(width)]
    for table, names in columns.items():
        cells = []
        for c in names:
            bits = [F.lit(1 << key % BITS if w == key // BITS else 0).cast("long").alias(k) for w, k in enumerate(words)]
            cells.append(F.struct(strip_blanks(F.col(f"`{c}`").cast("string")).alias("value"), *bits))
            key += 1
        if cells:
            frames.append(tables[table].select(F.inline(F.array(*cells))))
    rows = reduce(lambda a, b: a.unionByName(b), frames).filter("value is not null")
    return rows.groupBy("value").agg(*(F.bit_or(k).alias(k) for k in words))


def _keys(width: int, columns: int) -> Column:
    """The numbers of the columns in a mask."""

    def held(w: int) -> Column:
        numbers = F.sequence(F.lit(BITS * w), F.lit(min(BITS * w + BITS, columns) - 1))
        return F.filter(numbers, lambda i: F.getbit(f"k{w}", i - BITS * w) == 1)

    return F.concat(*map(held, range(width)))


def slack(sample: int, miss: float = MISS) -> float:
    """How far a sample's share lies below the true one with a chance of ``miss`` at most."""
    return math.sqrt(math.log(1 / miss) / (2 * sample))


def containments(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], least: float = 0.5, sketch: int = SKETCH) -> DataFrame:
    """Ordered pairs of columns of different tables with match >= least: from_table, from_column, to_table, to_column,
    from_keys, to_keys, shared, match (the share of the from side's values that the to side holds)."""
    held = stage(values_with_keys(tables, columns), "key-values")
    words = held.columns[1:]
    listed = [(i, t, c) for i, (t, c) in enumerate((t, c) for t, names in columns.items() for c in names)]
    names = held.sparkSession.createDataFrame(listed, "key int, table_name string, column_name string")
    keys = _keys(len(words), len(listed))
    sets = stage(held.groupBy(*words).agg(F.count(F.lit(1)).alias("values")).select(keys.alias("keys"), "values"), "key-sets")
    sizes = stage(sets.select(F.explode("keys").alias("key"), "values").groupBy("key").agg(F.sum("values").alias("n")), "key-sizes")

    # a share of a column's hashes that gives four times the sketch on average; all of a column not much larger than that
    share = F.xxhash64("value").cast("double") / 2.0**64 + 0.5
    drawn = held.select(share.alias("share"), keys.alias("keys")).withColumn("from_key", F.explode("keys"))
    drawn = drawn.join(sizes.withColumnRenamed("key", "from_key"), "from_key").filter(F.col("share") * F.col("n") <= 4 * sketch)
    hits = drawn.select("from_key", F.explode("keys").alias("to_key")).groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("hits"))
    sampled = hits.filter("from_key = to_key").select("from_key", F.col("hits").alias("sampled"))
    margin = F.sqrt(F.lit(math.log(1 / MISS)) / (2 * F.col("sampled")))
    floor = F.when(F.col("sampled") == F.col("n"), F.lit(least)).otherwise(least - margin) * F.col("sampled")
    likely = hits.filter("from_key <> to_key").join(sampled, "from_key").join(sizes.withColumnRenamed("key", "from_key"), "from_key").filter(F.col("hits") >= floor)
    a = names.toDF("from_key", "from_table", "from_column")
    b = names.toDF("to_key", "to_table", "to_column")
    likely = stage(likely.select("from_key", "to_key").join(a, "from_key").join(b, "to_key").filter("from_table <> to_table"), "key-pairs")

    from_side = sets.withColumn("from_key", F.explode("keys")).join(likely.select("from_key", "to_key"), "from_key")
    shared = from_side.filter(F.array_contains("keys", F.col("to_key"))).groupBy("from_key", "to_key").agg(F.sum("values").alias("shared"))
    out = likely.join(shared, ["from_key", "to_key"])
    out = out.join(sizes.toDF("from_key", "from_keys"), "from_key").join(sizes.toDF("to_key", "to_keys"), "to_key")
    out = out.withColumn("match", ratio(F.col("shared"), F.col("from_keys"))).filter(F.col("match") >= least)
    return out.select("from_table", "from_column", "to_table", "to_column", "from_keys", "to_keys", "shared", "match")
