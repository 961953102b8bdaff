"""Correlations of many columns from one pass: pairwise-complete moments per task, put together as a tree.

Each Arrow batch gives, for every pair of columns at once, the number of rows that have both, the means of either side
over these rows, and the centred sums of squares and products, as products of small matrices. Two such parts are added by
the rule for joining moments (the difference of the means enters the sums), which does not cancel out however far from
zero the values lie. A task adds up its batches and reports one row per pair; the tasks' rows, a few per task, are added the same
way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "a int, b int, n bigint, mean_a double, mean_b double, ss_a double, ss_b double, sp double"
_NAMES = ["n", "mean_a", "mean_b", "ss_a", "ss_b", "sp"]


def batch_moments(x: np.ndarray) -> list[np.ndarray]:
    """n, both means, both sums of squares and the sum of products of every pair of columns (NaN is missing)."""
    there = ~np.isnan(x)
    shift = np.where(there.any(0), np.nanmean(np.where(there.any(0), x, 0.0), 0), 0.0)
    mask, x = there.astype(np.float64), np.where(there, x - shift, 0.0)
    n = mask.T @ mask
    sums, squares, products = x.T @ mask, (x * x).T @ mask, x.T @ x
    rows = np.maximum(n, 1)
    mean_a, mean_b = sums / rows, sums.T / rows
    ss_a = np.maximum(squares - sums * mean_a, 0.0)
    return [n, mean_a + shift[:, None], mean_b + shift[None, :], ss_a, ss_a.T, products - sums * mean_b]


def joined(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """The moments of the rows of both parts."""
    n = one[0] + other[0]
    rows = np.maximum(n, 1)
    d_a, d_b = other[1] - one[1], other[2] - one[2]
    share, both = other[0] / rows, one[0] * other[0] / rows
    # a part without rows has no means of its own
    mean = [np.where(one[0] == 0, y, np.where(other[0] == 0, x, x + d * share)) for x, y, d in ((one[1], other[1], d_a), (one[2], other[2], d_b))]
    add = [both * d_a * d_a, both * d_b * d_b, both * d_a * d_b]
    return [n, *mean, *(x + y + z for x, y, z in zip(one[3:], other[3:], add))]


def correlations(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """a, b (names in the given order, a not after b), n (rows with both) and r (null without spread) of every pair."""
    names = list(columns)
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())))
    upper = np.triu_indices(len(names))

    def task(batches):
        total = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], 1)
            part = batch_moments(x)
            total = part if total is None else joined(total, part)
        if total is not None:
            cells = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[0][upper].astype(np.int64))]
            cells += [pa.array(m[upper]) for m in total[1:]]
            yield pa.RecordBatch.from_arrays(cells, names=["a", "b", *_NAMES])

    def put_together(key, table):
        parts = [table.column(name).to_numpy().astype(np.float64) for name in _NAMES]
        while len(parts[0]) > 1:  # neighbours in turn, so that the error grows with the height of the tree
            if len(parts[0]) % 2:
                parts = [np.append(p, 0.0) for p in parts]
            parts = joined([p[::2] for p in parts], [p[1::2] for p in parts])
        return pa.table({"a": key[:1], "b": key[1:], "n": pa.array(parts[0].astype(np.int64)), **{name: pa.array(p) for name, p in zip(_NAMES[1:], parts[1:])}})

    found = rows.mapInArrow(task, PART).groupBy("a", "b").applyInArrow(put_together, PART)
    labels = F.array(*map(F.lit, names))
    r = F.col("sp") / (F.sqrt("ss_a") * F.sqrt("ss_b"))
    spread = (F.col("ss_a") > 0) & (F.col("ss_b") > 0)
    return found.select(
        F.get(labels, F.col("a")).alias("a"), F.get(labels, F.col("b")).alias("b"), "n",
        F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
    )


def numeric_columns(df: DataFrame, taken: Sequence[str] = ()) -> list[str]:
    """The columns of numbers of a table, in order."""
    from tablewise.functions.columns import is_number

    return [f.name for f in df.schema.fields if is_number(f.dataType) and f.name not in taken]
