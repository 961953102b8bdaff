"""Exact top-k by inner product: columnar branch and bound.

Each component x becomes ``floor(scale * x)``; scores are integer inner products, so results are exact.
Queries and candidates are cut into blocks, and each block of queries meets each block of candidates in one cell of a grid, which
one task works on: nothing is broadcast or passes the driver, and a task holds about ``QUERY_BLOCK`` queries
and ``CELL`` candidates at most. A cell turns its candidates into column-wise blocks and adds up products one
group of dimensions after another. Candidates whose partial score plus the largest possible rest
(Cauchy-Schwarz on the remaining mass of both vectors) stays under the k-th best score so far are
dropped and the others moved together. Every cell returns k rows per query, and the best k of all are kept.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
Of vectors of different lengths the shorter is extended by zeros. Query rows that agree in id and vector are one
query; candidates that repeat are candidates each. Ties go to the smaller id. A row is no candidate for its own id.
Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm import texts
from tablewise.llm.common import stage

QUERY_BLOCK = 8192  # queries of a cell, at most
CELL = 1 << 16  # candidates of a cell, at most
CANDIDATE_BLOCK = LEAST_BLOCK = 8192  # candidates worked on at once; cells are not made smaller for the sake of tasks
GROUP = 16  # dimensions added at a time


def _integers(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id, v: the rows that take part, their components as integers."""

    def fine(x: Column) -> Column:
        # 0 * x is 0 only for finite x
        return x.isNotNull() & (F.coalesce(x.cast("double"), F.lit(float("nan"))) * 0 == 0)

    rows = df.select(df[vec_id].cast("long").alias("id"), df[vector].alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine))
    return rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as columns: (width, rows), extended by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((width, len(lengths)), np.int64)
    if (lengths == width).all():
        out[:] = flat.reshape(-1, width).T
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at, row] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= floor)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def _rest(block: np.ndarray) -> np.ndarray:
    """For every group of dimensions the norm of what comes from it on, of each column."""
    squares = block.astype(np.float64) ** 2
    starts = np.arange(0, len(block), GROUP)
    return np.sqrt(np.add.reduceat(squares, starts, axis=0)[::-1].cumsum(0)[::-1])


def _search(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, best: list, k: int) -> None:
    """Bring the best (scores, ids) of each query up to date with a block of candidates."""
    peak = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(block).max(initial=0)), 1)
    kind = np.float64 if peak * max(len(block), 1) < 2**52 else np.int64  # both exact
    q, v = queries.astype(kind), block.astype(kind)
    mass, remaining = _rest(queries), _rest(block)
    head = q[:GROUP].T @ v[:GROUP]
    for i in range(q.shape[1]):
        scores, place = head[i], np.flatnonzero(ids != query_ids[i])
        scores = scores[place]
        old_scores, old_ids = best[i]
        bound = old_scores[-1] if len(old_scores) >= k else None
        for g in range(1, len(mass)):
            if bound is not None:
                alive = scores + np.floor(mass[g, i] * remaining[g, place] * (1 + 1e-9)) + 1 >= bound
                scores, place = scores[alive], place[alive]
            if not len(place):
                break
            d = slice(g * GROUP, (g + 1) * GROUP)
            scores = scores + q[d, i] @ v[d][:, place]
        if not len(place):
            continue
        all_scores = np.concatenate([old_scores, scores.astype(np.int64)])
        all_ids = np.concatenate([old_ids, ids[place]])
        top = _best(all_scores, all_ids, k)
        best[i] = (all_scores[top], all_ids[top])


def _vectors(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """A group's vectors and ids; the columns of an empty side are not given."""
    if not table.num_rows:
        return pa.array([], pa.list_(pa.int64())), np.zeros(0, np.int64)
    return table.column("v").combine_chunks(), table.column("id").to_numpy()


def _cell(k: int):
    """The k best candidates of a cell for every query of it: query (its number), query_id, vec_id, score."""
    names = ["query", "query_id", "vec_id", "score"]

    def run(key, mine: pa.Table, stated: pa.Table) -> pa.Table:
        vectors, ids = _vectors(mine)
        asked, query_ids = _vectors(stated)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        if len(query_ids):
            lengths = [c.value_lengths().to_numpy(zero_copy_only=False).max(initial=1) for c in (vectors, asked)]
            width = max(int(max(lengths)), 1)
            wanted = _matrix(asked, width)
            for at in range(0, len(ids), CANDIDATE_BLOCK):
                part = vectors.slice(at, CANDIDATE_BLOCK)
                _search(wanted, query_ids, _matrix(part, width), ids[at : at + CANDIDATE_BLOCK], best, k)
        counts = [len(s) for s, _ in best]
        number = stated.column("query").to_numpy() if len(query_ids) else query_ids
        empty = [np.zeros(0, np.int64)]
        columns = [np.repeat(number, counts), np.repeat(query_ids, counts)]
        columns += [np.concatenate(empty + [b[i] for b in best]) for i in (1, 0)]
        out = pa.table([pa.array(c, pa.int64()) for c in columns], names=names)
        texts.give_back()
        return out

    return run


def cells(queries: int, candidates: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of candidates: each block of queries meets each block of candidates in one cell. Blocks are
    of bounded size, and small enough for every task to have some."""
    most = max(1, -(-candidates // LEAST_BLOCK))
    return max(1, -(-queries // QUERY_BLOCK)), max(1, -(-candidates // CELL), min(2 * tasks, most))


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every row with ``is_query``."""
    candidates = _integers(df, vec_id, vector, scale)
    queries = _integers(df.filter(is_query), vec_id, vector, scale).distinct()
    queries = stage(queries.withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    of_queries, of_candidates = cells(queries.count(), candidates.count(), df.sparkSession.sparkContext.defaultParallelism)

    def times(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = F.pmod(F.monotonically_increasing_id(), F.lit(of_candidates)).cast("int")  # even, whatever repeats
    mine = candidates.withColumn("c_block", own).withColumn("q_block", times(of_queries))
    stated = queries.withColumn("q_block", F.pmod(F.col("query"), F.lit(of_queries)).cast("int")).withColumn("c_block", times(of_candidates))
    cell = ["q_block", "c_block"]
    schema = "query bigint, query_id bigint, vec_id bigint, score bigint"
    found = mine.groupBy(*cell).cogroup(stated.groupBy(*cell)).applyInArrow(_cell(k), schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
