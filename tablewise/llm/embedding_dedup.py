"""Near-duplicate vectors by sorted projection passes.

1. Vectors that are equal in every component are one class, so copies are never compared.
2. Every pass has ``KEY_BITS`` random hyperplanes of its own. The sides of them that a vector lies on, one after
   another, are its key; the classes are put in lexicographic order of their keys (range partitions, sorted), and each is
   compared with the ``window`` classes before it, over the borders of partitions too.
3. Pairs whose cosine reaches the threshold are united over all passes. A task reports a spanning set of the links that
   it finds, not every pair.
4. The links inside each component are then counted exactly, whatever window they fell into: a component of at most
   ``TILE`` classes by one matrix product; a larger one in tiles of classes that lie equally far from its
   centre. Two classes at angles r and s from it are linked for certain if r + s is at most the threshold's
   angle, and apart for certain if r and s differ by more; only the other tiles are multiplied out. A dense group of any
   size is so counted from the sizes of its rings.

A pair at an angle of phi lands in one window with a chance of about ``(1 - phi / pi) ** log2(n / window)``; the number
of passes is taken from n so that a lone pair right at the threshold is met with ``recall``. Closer pairs and
members of larger groups are met more surely. What is reported is always verified in double precision.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors of another length, link with
nothing. Rows that repeat an id are rows of their own. A row without an id takes part; component_id is the smallest
id in reach, null if no row in reach has one. kept compares null as a value. Columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm import texts
from tablewise.llm.common import stage, without
from tablewise.llm.jaccard_join import _joined

KEY_BITS = 62
PASSES_AT_ONCE = 4  # of which the shuffle holds copies of the vectors
TILE = 1024
RINGS = 128  # of angles up to half a turn around a component's centre
_SURE = 1e-9  # what rounding may add to an angle
_BATCH_VALUES = 1 << 19


def passes_needed(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a lone pair right at the threshold was in one window with the chance ``recall``."""
    bits = max(0.0, math.log2(max(n, 2) / window))
    once = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log(1 - once))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, KEY_BITS))


def _named(df: DataFrame, vector: str, kept: list[str]) -> DataFrame:
    """The kept columns as __c0, __c1 ... and __class: a digest of the vector's bits, null where it cannot link."""
    rows = df.select(*[df[c].alias(f"__c{i}") for i, c in enumerate(kept)], df[vector].cast("array<double>").alias("__v"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__class", T.BinaryType())])

    def run(batches):
        for batch in batches:
            names = []
            lists = batch.column(len(kept))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null is NaN; one zero only
            begin = np.cumsum(size) - size
            for a, n in zip(begin.tolist(), size.tolist()):
                v = x[a : a + n]
                usable = n and np.isfinite(v).all() and v.any()
                names.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if usable else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.binary())], names=schema.names)

    return rows.mapInArrow(texts.lean(run), schema)


def _keyed(classes: DataFrame, numbers: list[int]) -> DataFrame:
    """pass, dim, key, id and v of every class, once for each pass."""
    element = classes.schema["v"].dataType.simpleString()

    def run(batches):
        known: dict[tuple[int, int], np.ndarray] = {}
        weights = np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                step = max(1, _BATCH_VALUES // dim)
                for a in range(0, len(rows), step):
                    part = pa.array(rows[a : a + step])
                    v = lists.take(part)
                    x = unit(_matrix(v, dim))
                    for number in numbers:
                        if (dim, number) not in known:
                            known[dim, number] = planes(dim, number)
                        key = ((x @ known[dim, number]) >= 0) @ weights
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(key), ids.take(part), v],
                            names=["pass", "dim", "key", "id", "v"],
                        )

    return classes.select("id", "v").mapInArrow(texts.lean(run), f"pass int, dim int, key bigint, id bigint, v {element}")


def spanning(x: np.ndarray, y: np.ndarray, reach: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` (pairs that ``reach`` allows) whose links hold all found ones together."""
    linked = ((x @ y.T) >= threshold) & reach
    if not linked.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    part = linked[np.ix_(rows, columns)]
    # breadth first from one row after another: each row and column is reported with the one that reached it
    a, b = [], []
    free_r, free_c = np.ones(len(rows), bool), np.ones(len(columns), bool)
    while free_r.any():
        front = np.array([np.argmax(free_r)])
        free_r[front] = False
        while len(front):
            hit = part[front] & free_c
            new = np.flatnonzero(hit.any(0))
            a.append(rows[front[hit[:, new].argmax(0)]]), b.append(columns[new])
            free_c[new] = False
            hit = part[:, new] & free_r[:, None]
            back = np.flatnonzero(hit.any(1))
            a.append(rows[back]), b.append(columns[new[hit[back].argmax(1)]] if len(back) else columns[:0])
            free_r[back] = False
            front = back
    return np.concatenate(a), np.concatenate(b)


def _windows(keyed: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links (a, b) found in the windows, and the first and last rows of each partition (kind 1 and 2)."""
    element = keyed.schema["v"].dataType.simpleString()
    schema = f"kind int, part int, pass int, dim int, key bigint, a bigint, b bigint, v {element}"

    def run(batches):
        part, list_type = TaskContext.get().partitionId(), None
        held, seen = None, 0  # the last ``window`` rows so far

        def borders(kind, table):
            n = table.num_rows
            whole = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32))]
            own = [table.column(i) for i in range(4)]
            return pa.RecordBatch.from_arrays([*whole, *own, pa.nulls(n, pa.int64()), table.column(4)], names=names)

        names = ["kind", "part", "pass", "dim", "key", "a", "b", "v"]
        for batch in batches:
            list_type = batch.column(4).type
            at = 0
            while at < batch.num_rows:
                now = batch.slice(at, window)
                if seen < window:
                    yield borders(1, now.slice(0, window - seen))
                found = _compared(held, now, threshold, window)
                if len(found[0]):
                    n = len(found[0])
                    empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *empty, pa.array(found[0]), pa.array(found[1]), pa.nulls(n, list_type)], names=names)
                joined = now if held is None else pa.concat_batches([held, now])
                held = joined.slice(max(0, joined.num_rows - window))
                seen += now.num_rows
                at += now.num_rows
        if held is not None:
            yield borders(2, held)

    return keyed.mapInArrow(texts.lean(run), schema)


def _compared(held: pa.RecordBatch | None, now: pa.RecordBatch, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most ``window`` consecutive rows with each other and with the rows held before them."""
    both = now if held is None else pa.concat_batches([held, now])
    before = 0 if held is None else held.num_rows
    kinds = both.column(0).to_numpy().astype(np.int64) << 32 | both.column(1).to_numpy()
    ids, found = both.column(3).to_numpy(), ([], [])
    for kind in np.unique(kinds[before:]):
        rows = np.flatnonzero(kinds == kind)
        x = unit(_matrix(both.column(4).take(pa.array(rows)), int(kind & 0xFFFFFFFF)))
        fresh = rows >= before
        gap = rows[fresh][:, None] - rows[None, :]
        a, b = spanning(x[fresh], x, (gap > 0) & (gap <= window), threshold)
        found[0].append(ids[rows[fresh][a]]), found[1].append(ids[rows[b]])
    return np.concatenate([np.zeros(0, np.int64), *found[0]]), np.concatenate([np.zeros(0, np.int64), *found[1]])


def _over_borders(found: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links between the last rows of a partition and the first ones of the next: at most ``2 * window`` rows a group."""
    rows = found.filter("kind > 0")
    border = F.when(F.col("kind") == 1, F.col("part") - 1).otherwise(F.col("part"))
    element = rows.schema["v"].dataType.simpleString()

    def compare(key, table):
        kind = table.column("kind").to_numpy()
        order = np.lexsort((table.column("a").to_numpy(), table.column("key").to_numpy(), table.column("dim").to_numpy(), table.column("pass").to_numpy(), -kind))
        table = table.take(pa.array(order)).select(["pass", "dim", "key", "a", "v"]).combine_chunks()
        batches = table.to_batches()
        if not batches:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both, last = batches[0], int((kind == 2).sum())
        a, b = _compared(both.slice(0, last), both.slice(last), threshold, window) if 0 < last < both.num_rows else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.select(border.alias("border"), "kind", "pass", "dim", "key", "a", F.col("v").cast(element).alias("v")).groupBy("border").applyInArrow(compare, "a bigint, b bigint")


def _small_counts(members: DataFrame, threshold: float) -> DataFrame:
    """id, links (copies of linked classes, itself not) of the classes of components of at most ``TILE`` classes."""

    def count(key, table):
        dim = int(table.column("dim")[0].as_py())
        x = unit(_matrix(table.column("v").combine_chunks(), dim))
        linked = (x @ x.T) >= threshold
        np.fill_diagonal(linked, False)
        links = linked @ table.column("copies").to_numpy()
        return pa.table({"id": table.column("id"), "links": pa.array(links.astype(np.int64))})

    return members.select("root", "id", "copies", "v", F.size("v").alias("dim")).groupBy("root").applyInArrow(count, "id bigint, links bigint")


def _centres(members: DataFrame) -> DataFrame:
    """root, centre: the mean direction of each component, from one partial sum per task."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            roots, lists = batch.column(0).to_numpy(), batch.column(1)
            for root in np.unique(roots).tolist():
                v = lists.take(pa.array(np.flatnonzero(roots == root)))
                x = unit(_matrix(v, len(v[0])))
                total[root] = total.get(root, 0) + x.sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.tolist() for t in total.values()])], names=["root", "part"])

    parts = members.select("root", "v").mapInArrow(texts.lean(sums), "root bigint, part array<double>")
    add = F.aggregate(F.collect_list("part"), F.expr("cast(array() as array<double>)"), lambda t, p: F.zip_with(t, p, lambda x, y: F.coalesce(x, F.lit(0.0)) + y))
    return parts.groupBy("root").agg(add.alias("centre"))  # one row for each task and component


def _ringed(members: DataFrame) -> DataFrame:
    """Members with their ring: angles to the centre from ring to ring + 1 steps of pi / RINGS."""
    joined = members.join(_centres(members), "root").select("root", "id", "copies", "v", "centre")
    element = members.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists, centres = batch.column(3), batch.column(4)
            size, ring = lists.value_lengths().to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                c = _matrix(centres.take(pa.array(rows)), dim)
                there = c.any(1)
                c[there] = unit(c[there])
                c[~there, 0] = 1.0  # opposite vectors may cancel out; any direction serves as a centre
                cosine = (unit(_matrix(lists.take(pa.array(rows)), dim)) * c).sum(1)
                angle = np.arccos(np.clip(cosine, -1, 1))
                ring[rows] = np.minimum(angle / math.pi * RINGS, RINGS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ring)], names=["root", "id", "copies", "v", "ring"])

    return joined.mapInArrow(texts.lean(run), f"root bigint, id bigint, copies bigint, v {element}, ring int")


def _large_counts(members: DataFrame, threshold: float) -> DataFrame:
    """The same of larger components, ring by ring."""
    rows = stage(_ringed(members), "vectors-rings")
    rings = rows.groupBy("root", "ring").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    step, most = math.pi / RINGS, math.acos(threshold)
    near, far = F.col("ring") * step, (F.col("ring") + 1) * step
    o_near, o_far = F.col("o_ring") * step, (F.col("o_ring") + 1) * step
    other = rings.select("root", F.col("ring").alias("o_ring"), F.col("copies").alias("o_copies"), F.col("n").alias("o_n"))
    both = rings.join(other, "root")  # at most RINGS squared rows a component
    sure = far + o_far <= most - _SURE
    apart = F.greatest(o_near - far, near - o_far) > most + _SURE
    certain = both.groupBy("root", "ring").agg(F.sum(F.when(sure, F.col("o_copies")).otherwise(0)).alias("certain"))
    own = F.when(2 * far <= most - _SURE, F.col("copies")).otherwise(0)
    out = rows.join(certain, ["root", "ring"]).select("id", (F.col("certain") - own).alias("links"))

    # rings are cut into tiles; every tile of a ring meets every tile of the rings it may or may not be linked with
    open_ = both.filter(~sure & ~apart).select("root", "ring", "o_ring", F.ceil(F.col("n") / TILE).alias("tiles"), F.ceil(F.col("o_n") / TILE).alias("o_tiles"))
    mine = open_.select("root", "ring", "o_ring", "tiles", F.explode(F.sequence(F.lit(0), F.col("o_tiles") - 1)).alias("o_tile"))
    theirs = open_.select("root", F.col("ring").alias("o_ring"), F.col("o_ring").alias("ring"), F.col("tiles").alias("o_tiles"), F.explode(F.sequence(F.lit(0), F.col("o_tiles") - 1)).alias("tile"))
    spread = F.pmod(F.xxhash64("id"), F.col("tiles"))
    a = rows.join(mine, ["root", "ring"]).withColumn("tile", spread).withColumn("side", F.lit(0))
    b = rows.withColumnRenamed("ring", "o_ring").join(theirs, ["root", "o_ring"]).withColumn("o_tile", F.pmod(F.xxhash64("id"), F.col("o_tiles"))).withColumn("side", F.lit(1))
    columns = ["root", "ring", "tile", "o_ring", "o_tile", "side", "id", "copies", "v"]
    tiles = a.select(*columns).unionByName(b.select(*columns))

    def count(key, table):
        side = table.column("side").to_numpy()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        v = table.column("v").combine_chunks()
        x = unit(_matrix(v, len(v[0])))
        a, b = side == 0, side == 1
        linked = ((x[a] @ x[b].T) >= threshold) & (ids[a][:, None] != ids[b][None, :])
        return pa.table({"id": pa.array(ids[a]), "links": pa.array((linked @ copies[b]).astype(np.int64))})

    grouped = tiles.groupBy("root", "ring", "tile", "o_ring", "o_tile").applyInArrow(count, "id bigint, links bigint")
    return out.unionByName(grouped).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame, threshold: float = 0.9, recall: float = 0.95, window: int = 128,
    vec_id: str = "vec_id", vector: str = "embedding", passes: int | None = None,
) -> DataFrame:
    """``df`` with n_links, component_id and kept."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    kept = without(df, ["n_links", "component_id", "kept"])
    names = [c.lower() for c in kept]
    if not {vec_id.lower(), vector.lower()} <= set(names):
        raise ValueError("the id and the vector must not be named like a new column")
    rows = stage(_named(df, vector, kept), "vectors-named")
    row_id = F.col(f"__c{names.index(vec_id.lower())}")
    v = F.col(f"__c{names.index(vector.lower())}")
    if df.schema[vector].dataType != T.ArrayType(T.FloatType()):
        v = v.cast("array<double>")
    vectors = rows.filter("__class is not null").select("__class", row_id.cast("long").alias("first"), v.alias("v"))
    classes = vectors.groupBy("__class").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "vectors-classes")
    n = classes.count()
    edges, total = [], passes or passes_needed(n, threshold, window, recall)
    for at in range(0, total, PASSES_AT_ONCE):
        keyed = _keyed(classes, list(range(at, min(total, at + PASSES_AT_ONCE))))
        ordered = keyed.repartitionByRange("pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
        found = stage(_windows(ordered, threshold, window), "vectors-windows")
        edges.append(found.filter("kind = 0").select("a", "b"))
        edges.append(_over_borders(found, threshold, window))
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    labels = _joined(None, links)
    info = classes.select("id", "__class", "first", "copies").withColumn("root", F.col("id"))
    if labels is None:
        labels = links.sparkSession.createDataFrame([], "node bigint, root bigint")
    roots = labels.select(F.col("node").alias("id"), F.col("root"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = stage(classes.join(roots, "id").join(sizes, "root").select("root", "size", "id", "copies", "v"), "vectors-members")
    counts = _small_counts(members.filter(F.col("size") <= TILE), threshold)
    counts = counts.unionByName(_large_counts(members.filter(F.col("size") > TILE), threshold))
    info = info.drop("root").join(roots, "id", "left").join(counts, "id", "left")
    info = info.withColumn("root", F.coalesce("root", "id"))
    smallest = info.groupBy("root").agg(F.min("first").alias("component_id"))
    info = info.join(smallest, "root").select(
        "__class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(stage(info, "vectors-links"), "__class", "left")
    component = F.when(F.col("__class").isNull(), row_id.cast("long")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.col(vec_id).cast("long").eqNullSafe(F.col("component_id")))
