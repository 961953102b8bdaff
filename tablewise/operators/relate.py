"""Foreign-key discovery from shared key values.

All candidate columns are checked in one job: every distinct key value is reduced to a bit mask
of the columns it occurs in (``bit_or`` combines on the map side, so a hot value is one row per
task), and overlaps are counts over the masks. There is one shuffle, by value, whatever the
number of column pairs, and no limit on the number of keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import names, rules
from tablewise.functions.columns import ratio, rounded, strip_blanks
from tablewise.operators.profile import ColumnProfile

BITS = 62

RELATIONSHIP_SCHEMA = (
    "from_table string, from_column string, to_table string, to_column string, confidence string,"
    " match_percent double, view_name string"
)


@dataclass(frozen=True)
class Relationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    confidence: str
    match_percent: float
    view_name: str


Key = tuple[str, str]


def id_columns(profiles: Mapping[str, Sequence[ColumnProfile]]) -> dict[str, list[str]]:
    return {t: [p.column_name for p in ps if p.detected_type == "id"] for t, ps in profiles.items()}


def candidate_pairs(ids: Mapping[str, Sequence[str]]) -> list[tuple[Key, Key]]:
    """Id columns of different tables, in table order, whose names mean the same key."""
    keys = [(t, c) for t, columns in ids.items() for c in columns]
    place = {t: i for i, t in enumerate(ids)}
    return [
        (a, b)
        for a in keys
        for b in keys
        if place[a[0]] < place[b[0]] and same_stem(a[1], b[1])
    ]


def same_stem(left: str, right: str) -> bool:
    return names.same_key(names.key_stem(left), names.key_stem(right))


def key_overlap(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[Key, Key]]) -> DataFrame:
    """One row per pair: distinct keys on each side and how many they share."""
    keys = list(dict.fromkeys(k for pair in pairs for k in pair))
    number = {k: i for i, k in enumerate(keys)}
    occurrences = []
    for table, df in tables.items():
        wanted = [k for k in keys if k[0] == table]
        if not wanted:
            continue
        texts = df.select(
            *(strip_blanks(F.col(f"`{c}`").cast("string")).alias(str(number[t, c])) for t, c in wanted)
        )
        if len(wanted) == 1:
            only = str(number[wanted[0]])
            long = texts.select(F.lit(only).alias("key"), F.col(f"`{only}`").alias("value"))
        else:
            long = texts.unpivot([], [f"`{c}`" for c in texts.columns], "key", "value")
        occurrences.append(long.filter(F.col("value").isNotNull()))
    no = F.col("key").cast("int")
    words = range((len(keys) + BITS - 1) // BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), no % BITS)
    masks = (
        reduce(lambda a, b: a.unionByName(b), occurrences)
        .groupBy("value")
        .agg(
            *(
                F.bit_or(F.when(F.floor(no / BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
                for w in words
            )
        )
    )

    def has(key: Key) -> Column:
        i = number[key]
        return F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0

    totals = [F.count_if(has(k)).alias(f"n{i}") for k, i in number.items()]
    shared = [F.count_if(has(a) & has(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    rows = [
        F.struct(
            F.lit(i).alias("pair"),
            F.lit(a[0]).alias("from_table"), F.lit(a[1]).alias("from_column"),
            F.lit(b[0]).alias("to_table"), F.lit(b[1]).alias("to_column"),
            F.col(f"n{number[a]}").alias("from_keys"), F.col(f"n{number[b]}").alias("to_keys"),
            F.col(f"s{i}").alias("shared"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return masks.agg(*totals, *shared).select(F.inline(F.array(*rows)))


def match_share(overlap: DataFrame) -> DataFrame:
    """Share of the from side found on the to side, and the other way round."""
    return overlap.select(
        "*",
        F.coalesce(ratio(F.col("shared"), F.col("from_keys")), F.lit(0.0)).alias("match"),
        F.coalesce(ratio(F.col("shared"), F.col("to_keys")), F.lit(0.0)).alias("reverse_match"),
    )


def confidence_of(match: Column) -> Column:
    return (
        F.when(match >= rules.MATCH_HIGH, "high").when(match >= rules.MATCH_MIN, "medium").otherwise("low")
    )


def relationship_frame(
    tables: Mapping[str, DataFrame],
    profiles: Mapping[str, Sequence[ColumnProfile]],
    orient: str = "listed",
) -> DataFrame:
    """Relationships, strongest first.

    ``listed`` keeps the earlier table as the from side. ``contained`` turns a pair round when
    the other side is contained more fully, or as fully but repeats its keys more.
    """
    spark = next(iter(tables.values())).sparkSession
    pairs = candidate_pairs(id_columns(profiles)) if len(tables) > 1 else []
    if not pairs:
        return spark.createDataFrame([], RELATIONSHIP_SCHEMA)
    found = match_share(key_overlap(tables, pairs))
    if orient == "contained":
        repeats = {
            f"{t}.{p.column_name}": (p.total_rows - p.null_count) / max(p.unique_count, 1)
            for t, ps in profiles.items()
            for p in ps
        }
        rate = F.create_map(*(F.lit(x) for kv in repeats.items() for x in kv))
        side = {s: F.element_at(rate, F.concat_ws(".", f"{s}_table", f"{s}_column")) for s in ("from", "to")}
        turn = (F.col("reverse_match") > F.col("match")) | (
            (F.col("reverse_match") == F.col("match")) & (side["to"] > side["from"])
        )

        def swap(a, b):
            return F.when(turn, F.col(b)).otherwise(F.col(a))

        found = found.select(
            "pair",
            *(swap(f"from_{x}", f"to_{x}").alias(f"from_{x}") for x in ("table", "column")),
            *(swap(f"to_{x}", f"from_{x}").alias(f"to_{x}") for x in ("table", "column")),
            swap("match", "reverse_match").alias("match"),
        )
    view = {(a[0], b[0]): names.join_view_name(a[0], b[0]) for a, b in pairs}
    view |= {(b, a): names.join_view_name(b, a) for a, b in list(view)}
    view_name = F.create_map(*(F.lit(x) for (a, b), v in view.items() for x in (f"{a}\n{b}", v)))
    return (
        found.filter(F.col("match") >= rules.MATCH_MIN)
        .orderBy(F.desc("match"), "pair")
        .select(
            "from_table", "from_column", "to_table", "to_column",
            confidence_of(F.col("match")).alias("confidence"),
            rounded(F.col("match") * 100, 2).cast("double").alias("match_percent"),
            F.element_at(view_name, F.concat_ws("\n", "from_table", "to_table")).alias("view_name"),
        )
    )


def detect_relationships(tables, profiles, orient: str = "listed") -> list[Relationship]:
    return [Relationship(**r.asDict()) for r in relationship_frame(tables, profiles, orient).collect()]


def relationships_to_frame(spark, relationships: Sequence[Relationship]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in relationships], RELATIONSHIP_SCHEMA)
