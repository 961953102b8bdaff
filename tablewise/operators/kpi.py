"""Business metrics of one or many tables.

Every metric of a table, for every slice asked for (the whole table, or a current and a
previous period), comes from two aggregates:

* plain sums, maxima, counts and the date range: one pass, no row shuffle;
* distinct ids: (role, id) pairs carrying flags such as "has revenue" or "was delivered",
  combined per pair before and after one shuffle, then counted. A hot id is one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import names, rules
from tablewise.functions.columns import exact_amount, folded, is_text, ratio, to_moment, whole_days
from tablewise.operators.filters import DashboardFilters, apply_filters

Types = Mapping[str, str]


@dataclass(frozen=True)
class Roles:
    order: str | None = None
    customer: str | None = None
    product: str | None = None
    seller: str | None = None
    revenue: str | None = None
    date: str | None = None
    category: str | None = None
    status: str | None = None

    def ids(self) -> dict[str, str]:
        named = {"order": self.order, "customer": self.customer, "product": self.product, "seller": self.seller}
        return {role: c for role, c in named.items() if c}


def revenue_score(column: str, in_context: bool) -> int:
    name, points = column.lower(), rules.REVENUE_SCORES
    score = points["exact"] * (name in rules.REVENUE_EXACT)
    score += points["contains"] * sum(h in name and h != name for h in rules.REVENUE_EXACT)
    score += points["negative"] * names.contains_any(name, rules.REVENUE_NEGATIVE)
    score += points["word"] * names.contains_any(name, rules.REVENUE_WORDS)
    return score + (points["context"] if in_context else points["bare_word"] * (name in rules.REVENUE_WORDS))


def pick_revenue(columns: Sequence[str], table_name: str, order_column: str | None) -> str | None:
    in_context = order_column is not None or names.contains_any(table_name, rules.REVENUE_CONTEXT)
    ranked = sorted((-revenue_score(c, in_context), c.lower(), c) for c in columns)
    return ranked[0][2] if ranked and ranked[0][0] < 0 else None


def pick_roles(types: Types, table_name: str) -> Roles:
    usable = {c: t for c, t in types.items() if c not in rules.METRIC_BLOCKED}

    def typed(kind):
        return [c for c, t in usable.items() if t == kind]

    ids, dates = typed("id"), typed("datetime")
    order = names.first_hit(ids, rules.ORDER_HINTS)
    product_categories = [
        c
        for c in typed("category")
        if "category" in c.lower() and not names.contains_any(c, rules.CATEGORY_GEO_WORDS)
    ]
    status = [c for c in usable if "status" in c.lower() and names.contains_any(c, rules.STATUS_OWNERS)]
    return Roles(
        order=order,
        customer=names.first_hit(ids, rules.CUSTOMER_HINTS),
        product=names.first_hit(ids, rules.PRODUCT_HINTS),
        seller=names.first_hit(ids, rules.SELLER_HINTS),
        revenue=pick_revenue(typed("currency"), table_name, order),
        date=names.best_hit(dates, rules.SPAN_DATE_HINTS) if dates else None,
        category=next(iter(product_categories), None),
        status=next(iter(status), None),
    )


def _moment(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return to_moment(c) if is_text(df.schema[column].dataType) else c


def _distinct_counts(base: DataFrame, roles: Mapping[str, str], slices: Sequence[str]) -> DataFrame:
    """One row: per slice and role the distinct ids, those with revenue, those delivered."""
    flags = [f"{s}_{flag}" for s in slices for flag in ("in", "paid", "done")]
    pairs = base.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(role).alias("role"), F.col(f"id_{role}").cast("string").alias("id"))
                    for role in roles
                )
            )
        ).alias("k"),
        *flags,
    ).select("k.*", *flags)
    per_id = (
        pairs.filter(F.col("id").isNotNull())
        .groupBy("role", "id")
        .agg(*(F.bool_or(flag).alias(flag) for flag in flags))
    )
    return per_id.agg(
        *(
            F.count_if((F.col("role") == role) & F.col(flag)).alias(f"{role}_{flag}")
            for role in roles
            for flag in flags
        )
    )


def metric_rows(
    df: DataFrame,
    table_name: str,
    types: Types,
    slices: Mapping[str, Column] | None = None,
    roles: Roles | None = None,
) -> DataFrame:
    """Long rows (slice, table_name, kpi_name, kpi_value, unit, category, tier), one per metric
    the table supports; ``slices`` maps a name to a row condition."""
    roles = roles or pick_roles(types, table_name)
    conditions = dict(slices or {"all": F.lit(True)})
    if slices:
        df = df.filter(reduce(lambda a, b: a | b, conditions.values()))
    ids = roles.ids() | ({"category": roles.category} if roles.category else {})
    amount = (
        exact_amount(F.col(f"`{roles.revenue}`"), df.schema[roles.revenue].dataType)
        if roles.revenue
        else F.lit(None).cast("decimal(18,4)")
    )
    done = (
        F.coalesce(folded(F.col(f"`{roles.status}`").cast("string")) == rules.DELIVERED, F.lit(False))
        if roles.status
        else F.lit(False)
    )
    base = df.select(
        *(F.col(f"`{c}`").alias(f"id_{role}") for role, c in ids.items()),
        amount.alias("amount"),
        (_moment(df, roles.date) if roles.date else F.lit(None).cast("timestamp")).alias("moment"),
        done.alias("done"),
        *(F.coalesce(test, F.lit(False)).alias(f"{s}_in") for s, test in conditions.items()),
    ).select(
        "*",
        *(
            flag
            for s in conditions
            for flag in (
                (F.col(f"{s}_in") & F.col("amount").isNotNull()).alias(f"{s}_paid"),
                (F.col(f"{s}_in") & F.col("done")).alias(f"{s}_done"),
            )
        ),
    )
    measures = []
    for s in conditions:
        inside = F.col(f"{s}_in")
        paid = F.when(inside, F.col("amount"))
        measures += [
            F.sum(paid).alias(f"{s}_revenue"),
            whole_days(F.max(F.when(inside, F.col("moment"))), F.min(F.when(inside, F.col("moment")))).alias(
                f"{s}_span"
            ),
            F.count_if(inside).alias(f"{s}_rows"),
            F.count_if(F.col(f"{s}_done")).alias(f"{s}_rows_done"),
        ]
        for role in ("order", "customer"):
            if role in ids:
                keyed = F.when(F.col(f"id_{role}").isNotNull(), paid)
                measures.append(F.sum(keyed).alias(f"{s}_revenue_{role}"))
        if "order" in ids:
            top = F.max(F.when(F.col("id_order").isNotNull(), paid))
            measures.append(top.alias(f"{s}_top"))
    one_row = base.agg(*measures)
    if ids:
        counts = _distinct_counts(base, ids, list(conditions))
        one_row = one_row.withColumn("d", counts.select(F.struct("*")).scalar())
    entries = [e for s in conditions for e in _entries(s, roles, ids)]
    if not entries:
        entries = [_entry("all", "none", F.lit(None), "", "", 9)]
    long = one_row.select(F.inline(F.array(*entries)))
    return long.filter(F.col("kpi_value").isNotNull()).select(
        "slice", F.lit(table_name).alias("table_name"), "kpi_name", "kpi_value", "kpi_unit", "kpi_category", "tier",
    )


def _entry(s: str, name: str, value: Column, unit: str, category: str, tier: int) -> Column:
    return F.struct(
        F.lit(s).alias("slice"), F.lit(name).alias("kpi_name"), value.cast("double").alias("kpi_value"),
        F.lit(unit).alias("kpi_unit"), F.lit(category).alias("kpi_category"), F.lit(tier).alias("tier"),
    )


def _entries(s: str, roles: Roles, ids: Mapping[str, str]) -> list[Column]:
    def distinct(role, flag="in"):
        return F.col("d")[f"{role}_{s}_{flag}"]

    revenue = F.col(f"{s}_revenue")
    out = []
    if roles.revenue:
        out.append(_entry(s, "Total Revenue", F.round(revenue, 2), "currency", "sales", 1))
        if roles.order:
            per_order = ratio(F.col(f"{s}_revenue_order"), distinct("order", "paid"))
            out.append(_entry(s, "Avg Order Value", per_order, "currency", "sales", 1))
            out.append(_entry(s, "Max Transaction", F.round(f"{s}_top", 2), "currency", "sales", 2))
        if roles.customer:
            per_customer = ratio(F.col(f"{s}_revenue_customer"), distinct("customer", "paid"))
            out.append(
                _entry(
                    s, "Revenue per Customer", F.round(per_customer.cast("decimal(28,6)"), 2),
                    "currency", "customer", 1,
                )
            )
    for role, name, category in (
        ("order", "Total Orders", "sales"),
        ("customer", "Total Customers", "customer"),
        ("product", "Total Products", "inventory"),
        ("seller", "Active Sellers", "sales"),
    ):
        if role in ids:
            out.append(_entry(s, name, distinct(role), "count", category, 1))
    if roles.date:
        span = F.when(F.col(f"{s}_span") > 0, F.col(f"{s}_span"))
        out.append(_entry(s, "Data Time Span", span, "days", "general", 2))
    if roles.category:
        kinds = F.when(distinct("category") > 1, distinct("category"))
        out.append(_entry(s, "Product Categories", kinds, "count", "inventory", 2))
    if roles.status:
        if roles.order:
            share = ratio(distinct("order", "done"), distinct("order"))
        else:
            share = ratio(F.col(f"{s}_rows_done"), F.col(f"{s}_rows"))
        rate = F.round((share * 100).cast("decimal(28,6)"), 1)
        out.append(_entry(s, "Delivery Rate", rate, "percent", "sales", 1))
    return out


def _category_rank() -> Column:
    rank = F.lit(9)
    for i, name in enumerate(rules.METRIC_CATEGORY_ORDER):
        rank = F.when(F.col("kpi_category") == name, i).otherwise(rank)
    return rank


def confidence() -> Column:
    """How much to trust a metric, from its name, unit and value."""
    name, value = F.lower("kpi_name"), F.col("kpi_value")

    def when(test: Column, points: float) -> Column:
        return F.when(test, points).otherwise(0.0)

    score = (
        F.lit(0.68)
        + when(name.rlike("revenue|orders|customers"), 0.12)
        + when(name.contains("rate") | F.col("kpi_unit").contains("percent"), 0.05)
        + when(name.contains("avg"), 0.04)
        - when(value == 0, 0.15)
        - when(value < 0, 0.05)
    )
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.99), score)), 2)


DISPLAY_FORMATS = {
    "currency": "${value:,.2f}",
    "count": "{value:,.0f}",
    "percent": "{value:.1f}%",
    "days": "{value:.0f} days",
}


def top_metrics(rows: DataFrame, table_order: Sequence[str], keep: int | None = None) -> DataFrame:
    """One row per metric name (lowest tier, then first table) in order, or the ``keep`` foremost.

    The windows run over metric rows, a handful per table."""
    place = F.array_position(F.array(*(F.lit(t) for t in table_order)), F.col("table_name"))
    per_name = Window.partitionBy("slice", "kpi_name").orderBy("tier", place)
    per_slice = Window.partitionBy("slice").orderBy("tier", _category_rank(), "kpi_name")
    ranked = (
        rows.withColumn("copy", F.row_number().over(per_name))
        .filter("copy = 1")
        .withColumn("rank", F.row_number().over(per_slice))
        .drop("copy")
    )
    return ranked if keep is None else ranked.filter(F.col("rank") <= keep)


def calculate_metrics(
    tables: Mapping[str, DataFrame],
    types: Mapping[str, Types],
    filters: DashboardFilters | None = None,
    roles: Mapping[str, Roles] | None = None,
) -> DataFrame:
    """The session's metrics, ranked, with confidence and display text."""
    frames = [
        metric_rows(apply_filters(df, filters), name, types[name], roles=(roles or {}).get(name))
        for name, df in tables.items()
    ]
    ranked = top_metrics(reduce(lambda a, b: a.unionByName(b), frames), list(tables))
    formats = F.create_map(*(F.lit(x) for kv in DISPLAY_FORMATS.items() for x in kv))
    pattern = F.when(F.col("kpi_name") == "Product Categories", F.lit("{value:.0f}")).otherwise(
        F.element_at(formats, F.col("kpi_unit"))
    )
    return ranked.orderBy("rank").select(
        "kpi_name", "kpi_value", "kpi_unit", "kpi_category", pattern.alias("display_format"),
        "tier", confidence().alias("confidence"), "table_name", "rank",
    )


def by_category_and_name(metrics: DataFrame) -> DataFrame:
    """Read-back order of stored metrics."""
    return metrics.orderBy("kpi_category", "kpi_name")
