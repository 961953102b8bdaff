"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends from the root: at each level every child draws ``ln(u) / weight`` with ``u`` from a hash of
the row's key and the child's name, and the largest draw wins, so children get rows in proportion to their
weights. A draw depends on that child alone. When a weight changes, rows move only into or out of the
subtree whose weight changed; all other placements stay. ``grow`` adds a shard in a region of its own:
rows move only into the new shard.

Only built-in functions are used and placement needs no shuffle. A null key is a key like any other.
``slots`` numbers the rows of every shard from 0 without gaps: rows are numbered within small hash buckets
of a shard, and the buckets' counts give their first numbers, so no task holds a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256  # per shard, for numbering
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 5


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def standard_tree(shards: int) -> list[Leaf]:
    """Equal shards, five to a rack and two racks to a region."""
    region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [Leaf(f"r{i // region}", f"k{i % region // SHARDS_PER_RACK}", i) for i in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region."""
    shard = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"grown{shard}", "k0", shard, weight)]


def _choose(key: Column, children: Column) -> Column:
    """The child with the largest draw, of an array of structs with name and weight."""

    def draw(child: Column) -> Column:
        # 53 bits of the hash, never 0 or 1
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.log(u) / child["weight"]).alias("draw"), child.alias("child"))

    return F.array_max(F.transform(children, draw))["child"]


def _node(name: str, weight: float, **more: Column) -> Column:
    columns = {"name": F.lit(name), "weight": F.lit(float(weight)), **more}
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard that a key descends to; a tree without weight has none."""
    if any(leaf.weight < 0 for leaf in tree):
        raise ValueError("weights may not be negative")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        return F.lit(None).cast("int")

    def rack_node(name, leaves):
        shards = [_node(f"{name}/{x.shard}", x.weight, shard=F.lit(x.shard).cast("int")) for x in leaves]
        return _node(name, sum(x.weight for x in leaves), below=F.array(*shards))

    def region_node(name, racks):
        below = F.array(*[rack_node(f"{name}/{rack}", leaves) for rack, leaves in racks.items()])
        return _node(name, sum(x.weight for leaves in racks.values() for x in leaves), below=below)

    region = _choose(key, F.array(*[region_node(name, racks) for name, racks in regions.items()]))
    rack = _choose(key, region["below"])
    return _choose(key, rack["below"])["shard"]


def slots(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """``df`` with the number of each row in its shard, by hash bucket and then by ``order``.

    Rows that agree in all of ``order`` may change places with each other.
    """
    bucket = F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(BUCKETS)).cast("int")
    rows = df.withColumn("__bucket", bucket)
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    number = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order)) - 1
    numbered = rows.withColumn("__number", number).join(first, [shard, "__bucket"])
    return numbered.select(*df.columns, (F.col("__first") + F.col("__number")).cast("long").alias(name))


def assign(df: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, size in bytes plus 16, CRC-32 of the text, shard, slot, shard after one growth.

    A null text has no bytes. Other columns of ``df`` do not matter.
    """
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(
        df[key].alias(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(df[key], tree).alias("shard"),
        shard_of(df[key], grow(tree)).alias("grown_shard"),
    )
    return slots(rows, "shard", [key, "text_crc32", "size"])
