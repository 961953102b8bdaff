"""Exact quantiles that never gather a column in one task.

Spark's ``percentile`` keeps a value→count map per group in memory, which is exact but
unbounded. Here each order statistic is bracketed with a sketch (``percentile_approx``, bounded
state) and the values in and around the bracket are counted; the bracket shrinks by orders of
magnitude per round, and once it holds at most ``limit`` values the statistic is picked from their
counts. Counting makes the result exact whatever the sketch returns. A column of any size takes the
same steps; one of few values starts with a bracket that is small already.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REST = 100_000  # values that are ordered in one task
SKETCH = 1_000


@dataclass(frozen=True)
class Quantiles:
    count: int
    values: tuple[float | None, ...]


@dataclass
class _Bracket:
    """The statistic is the ``offset``-th smallest of the ``size`` values strictly between
    ``low`` and ``high``."""

    column: str
    offset: int
    size: int
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def above(self) -> Column:
        v = F.col(self.column)
        return v.isNotNull() if self.low is None else v > self.low

    def inside(self) -> Column:
        v, test = F.col(self.column), self.above()
        if self.high is not None:
            test = test & (v < self.high)
        return test


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: Sequence[float],
    limit: int = REST,
) -> dict[str, Quantiles]:
    """Linear-interpolation quantiles of numeric expressions, nulls ignored. Runs Spark jobs;
    only counts and the quantiles themselves reach the driver."""
    if not columns:
        return {}
    aliases = {f"q{i}": name for i, name in enumerate(columns)}
    values = df.select(*(columns[name].alias(a) for a, name in aliases.items()))
    counts = values.agg(*(F.count(a).alias(a) for a in aliases)).first().asDict()
    found = _statistics(values, {a: n for a, n in counts.items() if n}, probabilities, limit)
    nothing = (None,) * len(probabilities)
    return {name: Quantiles(counts[a], found.get(a, nothing)) for a, name in aliases.items()}


def _statistics(
    values: DataFrame, sizes: dict[str, int], probabilities: Sequence[float], limit: int
) -> dict[str, tuple[float, ...]]:
    """All columns together: the passes over the data do not grow with their number."""
    places = {c: [p * (n - 1) for p in probabilities] for c, n in sizes.items()}
    brackets = {
        (c, rank): _Bracket(c, rank, sizes[c])
        for c, at in places.items()
        for place in at
        for rank in (math.floor(place), math.ceil(place))
    }
    while open_ := [b for b in brackets.values() if b.found is None and b.size > limit]:
        _shrink(values, open_)
    _pick(values, [b for b in brackets.values() if b.found is None])

    def between(c: str, place: float) -> float:
        low, high = brackets[c, math.floor(place)].found, brackets[c, math.ceil(place)].found
        return low + (high - low) * (place - math.floor(place))

    return {c: tuple(between(c, place) for place in at) for c, at in places.items()}


def _shared(brackets: list[_Bracket]) -> list[list[_Bracket]]:
    """Brackets with the same ends together."""
    groups: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        groups.setdefault((b.column, b.low, b.high), []).append(b)
    return list(groups.values())


def _shrink(values: DataFrame, brackets: list[_Bracket]) -> None:
    """One sketch pass and one counting pass for all open brackets; brackets with the same ends
    share a sketch, and what lies below an edge and at it is counted once for all of them."""
    shared = _shared(brackets)
    sketches = []
    for group in shared:
        edges = []
        for b in group:
            centre = b.offset / max(b.size - 1, 1)
            edges += [max(0.0, centre - 2 / SKETCH), min(1.0, centre + 2 / SKETCH)]
        member = F.when(group[0].inside(), F.col(group[0].column))
        sketches.append(F.percentile_approx(member, F.array(*map(F.lit, edges)), SKETCH))
    found = values.agg(*sketches).first()
    jobs, measures = [], []
    for g, group in enumerate(shared):
        v, above = F.col(group[0].column), group[0].above()
        for e in sorted(set(found[g])):
            measures += [F.count_if(above & (v < e)).alias(f"l{len(measures)}"), F.count_if(v == e).alias(f"e{len(measures)}")]
        jobs += [(g, b, found[g][2 * i], found[g][2 * i + 1]) for i, b in enumerate(group)]
    counted = iter(values.agg(*measures).first())
    less, equal = {}, {}
    for g in range(len(shared)):
        for e in sorted(set(found[g])):
            less[g, e], equal[g, e] = next(counted), next(counted)
    for g, b, a, z in jobs:
        under, at_a = less[g, a], equal[g, a]
        between, at_z = (less[g, z] - under - at_a, equal[g, z]) if z > a else (0, 0)
        k = b.offset
        if k < under:
            b.high, b.size = a, under
        elif k < under + at_a:
            b.found = a
        elif k < under + at_a + between:
            b.low, b.high, b.offset, b.size = a, z, k - under - at_a, between
        elif k < under + at_a + between + at_z:
            b.found = z
        else:
            passed = under + at_a + between + at_z
            b.low, b.offset, b.size = z, k - passed, b.size - passed


def _pick(values: DataFrame, brackets: list[_Bracket]) -> None:
    """At most ``limit`` values are left in each bracket, so one ordered running count for all
    brackets with the same ends is cheap."""
    if not brackets:
        return
    shared = _shared(brackets)
    members = [
        F.when(group[0].inside(), F.struct(F.lit(g).alias("b"), F.col(group[0].column).cast("double").alias("v")))
        for g, group in enumerate(shared)
    ]
    # a filter would be pushed below the reading of texts as numbers and repeat it for every test
    some = reduce(lambda a, b: a | b, (group[0].inside() for group in shared))
    inside = values.select(F.explode(F.when(some, F.array_compact(F.array(*members)))).alias("m"))
    counts = inside.groupBy("m.b", "m.v").agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("v")))
    wanted = [(g, b) for g, group in enumerate(shared) for b in group]
    picked = running.agg(*(F.min(F.when((F.col("b") == g) & (F.col("upto") > b.offset), F.col("v"))) for g, b in wanted))
    for (_, b), value in zip(wanted, picked.first()):
        b.found = value
