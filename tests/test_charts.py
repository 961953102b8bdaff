import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import charts, group_quantiles, insights, moments
from tablewise.operators.charts import ChartSpec
from tablewise.operators.profile import ColumnProfile
from tablewise.operators.relate import Relationship
from tablewise.plans import chart_choice


def column(name, kind, unique=5):
    return ColumnProfile(name, kind, 0, 0.0, unique, (), 0, 100, "text", False, True)


def test_chart_rules():
    profile = [
        column("order_id", "id", 100), column("purchase_date", "datetime"), column("payment_value", "currency"),
        column("order_status", "category", 3), column("customer_state", "category", 27), column("zip_code_prefix", "category", 9),
        column("a", "numeric"), column("b", "numeric"), column("c", "numeric"), column("box_weight", "numeric"),
    ]
    specs = chart_choice.charts_for_table("t", profile)
    kinds = [(s.chart_type, s.x_column, s.y_column, s.group_by_column, s.priority) for s in specs]
    assert kinds == [
        ("line", "purchase_date", "payment_value", None, 1),
        ("bar", "order_status", "payment_value", None, 2),
        ("treemap", "customer_state", "payment_value", None, 3),
        ("pie", "order_status", None, None, 3),
        ("heatmap", "a,b,c", None, None, 5),
        ("line", "purchase_date", "payment_value", "order_status", 4),
    ]
    assert specs[0].chart_title == "Payment Value Over Time"


def test_no_dates_and_freight():
    profile = [column("price", "currency"), column("freight_value", "currency")]
    assert [s.chart_type for s in chart_choice.charts_for_table("t", profile)] == ["histogram", "scatter"]


def test_choice_dedupes_titles_and_numbers_by_priority():
    profile = [column("d_date", "datetime"), column("revenue", "currency"), column("x_type", "category", 4)]
    specs = chart_choice.choose_charts({"a": profile, "b": profile})
    assert [s.chart_order for s in specs] == list(range(1, len(specs) + 1))
    assert len({s.chart_title for s in specs}) == len(specs) and {s.source_table for s in specs} == {"a"}
    assert [s.priority for s in specs] == sorted(s.priority for s in specs)


def test_cross_table_choice(spark):
    profiles = {"o": [column("k", "id"), column("d_date", "datetime")], "i": [column("k", "id"), column("price", "currency")]}
    link = Relationship("i", "k", "o", "k", "high", 100.0, "view_i_o")
    tables = {
        "o": spark.createDataFrame([("a", "2024-01-05")], "k string, d_date string"),
        "i": spark.createDataFrame([("a", 2.0), ("a", 3.0)], "k string, price double"),
    }
    (cross,) = chart_choice.cross_table_charts(profiles, [link], tables)
    assert (cross.dated_table, cross.paid_table, cross.spec.y_column) == ("o", "i", "price")
    assert chart_choice.cross_table_charts(profiles, [link], tables | {"i": tables["i"].limit(0)}) == []


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(f"g{i % 20}", i % 7 * 1.5 if i % 13 else None, f"2024-{i % 12 + 1:02d}-03", float(i % 9)) for i in range(400)]
    return spark.createDataFrame(rows, "g string, v double, d string, w double")


def test_all_groups_unless_a_number_is_given(sales):
    for chart in (charts.bar, charts.pie, charts.funnel, charts.treemap):
        assert chart(sales, "g").count() == 20
    assert charts.bar(sales, "g", "v", k=15).count() == 15
    other = charts.pie(sales, "g", slices=6)
    assert other.count() == 6 and other.agg(F.sum("value")).first()[0] == 400


def test_line_by_month(sales):
    rows = charts.line(sales, "d", "v", aggregation="count").collect()
    assert len(rows) == 12 and sum(r["value"] for r in rows) == sales.filter("v IS NOT NULL").count()
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)


def test_long_series_are_whole(spark):
    rows = spark.range(8000).selectExpr(
        "concat('g', id % 10) g", "make_date(2000 + cast(id / 10 / 12 as int) % 66, 1 + cast(id / 10 as int) % 12, 1) d", "1.0D v"
    )
    data = charts.line(rows, "d", "v", "g")
    assert data.count() == rows.selectExpr("date_trunc('month', d)", "g").distinct().count() > 500
    keyed = rows.selectExpr("monotonically_increasing_id() k", "d", "v")
    assert charts.cross_table_line(keyed, keyed, "k", "k", "d", "v").agg(F.sum("value")).first()[0] == 8000


def test_share_is_of_all_groups(spark):
    groups = spark.range(1000).selectExpr("concat('g', id % 100) g", "1.0D v")
    spec = ChartSpec("bar", "V by G", "t", "g", "v")
    text = insights.fallback_insight(insights.chart_sample(spec, groups), "V by G", "bar").first()["insight_text"]
    assert "1.0% of the sum over 100 groups" in text


def test_histogram_covers_all_rows(sales, spark):
    rows = charts.histogram(sales, "v", bins=4).collect()
    assert sum(r["value"] for r in rows) == sales.filter("v IS NOT NULL").count()
    assert rows[0]["lower"] == 0.0 and rows[-1]["upper"] == 9.0
    flat = charts.histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), "v").collect()
    assert [(r["bin"], r["value"]) for r in flat] == [(0, 5)]


def test_box_and_heatmap(sales):
    known = np.array([r["v"] for r in sales.collect() if r["v"] is not None])
    row = charts.box(sales, "v", limit=10).first()
    assert np.allclose([row["q1"], row["median"], row["q3"]], np.quantile(known, [0.25, 0.5, 0.75]))
    cells = {(r["x"], r["grp"]): r["value"] for r in charts.heatmap(sales, ["v", "w"]).collect()}
    pairs = np.array([(r["v"], r["w"]) for r in sales.collect() if r["v"] is not None])
    assert cells["v", "w"] == cells["w", "v"] == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=6e-4)
    assert cells["v", "v"] == 1.0


def test_sample_is_repeatable(sales):
    first = charts.scatter(sales, "v", "w", k=50).collect()
    assert len(first) == 50 and sorted(first) == sorted(charts.scatter(sales.repartition(7), "v", "w", k=50).collect())
    assert sorted(first) != sorted(charts.scatter(sales, "v", "w", k=50, seed=7).collect())


def test_unknown_chart(sales):
    with pytest.raises(ValueError, match="Unknown chart type"):
        charts.chart_data(ChartSpec("radar", "t", "s", "g"), {"s": sales})
    for kind in ("line", "bar", "pie", "scatter", "histogram", "treemap", "box", "funnel"):
        spec = ChartSpec(kind, "t", "s", {"line": "d", "scatter": "v", "histogram": "v", "box": "v"}.get(kind, "g"), "w")
        assert charts.chart_data(spec, {"s": sales}).count() > 0


def test_insights(spark):
    data = spark.createDataFrame([("north", 75.0), ("south", 25.0)], "x string, value double")
    text = insights.fallback_insight(data, "Sales", "pie").first()["insight_text"]
    assert text == "north leads with 75.00, 75.0% of the sum over 2 groups."
    spread = insights.fallback_insight(data, "Sales", "line").first()["insight_text"]
    assert spread.startswith("Values lie between 25.00 and 75.00")
    empty = insights.fallback_insight(data.limit(0), "Sales", "line").first()["insight_text"]
    assert empty.startswith("Sales: 0 points")


def test_executive_summary(spark):
    metrics = spark.createDataFrame([("Total Revenue", 1200.0, "currency", "sales")], "kpi_name string, kpi_value double, kpi_unit string, kpi_category string")
    texts = spark.createDataFrame([("Old.", 1), ("Revenue grew.", 2)], "insight_text string, generated_at long")
    assert insights.executive_summary(metrics, texts).first()[0] == "Total Revenue is 1,200.00 currency. Revenue grew."
    assert insights.executive_summary(metrics.limit(0), texts.limit(0)).first()[0].startswith("There are no metrics yet.")


def test_samples(sales):
    """What an insight is written from covers all months, groups and values."""
    values = sales.filter("v IS NOT NULL").count()
    assert insights.chart_sample(ChartSpec("line", "t", "s", "d", "v"), sales).count() == 12
    assert insights.chart_sample(ChartSpec("bar", "t", "s", "g", "v"), sales).count() == 20
    assert insights.chart_sample(ChartSpec("pie", "t", "s", "g", aggregation="count"), sales).count() == 20
    assert insights.chart_sample(ChartSpec("histogram", "t", "s", "v", aggregation="count"), sales).count() == values
    assert insights.chart_sample(ChartSpec("heatmap", "t", "s", "v,w", aggregation="correlation"), sales) is None


@pytest.mark.parametrize("limit", [20, 2000])
def test_group_quantiles_equal_numpy(spark, limit):
    rng, at = np.random.default_rng(limit), (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    groups = {
        "hot": np.append(rng.normal(size=3000), [1e300, -1e300, 5e-324]), "ties": np.repeat([2.0, 3.0, -0.0], [500, 1, 400]),
        "one": np.array([4.0]), "steep": 10.0 ** rng.integers(-30, 30, 90), **{f"g{i}": rng.exponential(size=i + 2) for i in range(60)},
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(None, 1.0), ("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = group_quantiles.group_quantiles(df, F.col("g"), F.col("v"), at, limit).collect()
    assert {r["g"]: r["count"] for r in found} == {g: len(v) for g, v in groups.items()}
    for r in found:
        assert np.allclose([r[f"q{i}"] for i in range(len(at))], np.quantile(groups[r["g"]], at), rtol=1e-9)
    assert group_quantiles.group_quantiles(df.limit(0), F.col("g"), F.col("v"), at).count() == 0


def test_box_by_group_is_the_box_of_each(spark, sales):
    spec = ChartSpec("box", "t", "s", "v", group_by_column="g")
    found = {r["grp"]: r for r in charts.chart_data(spec, {"s": sales}).collect()}
    for grp, r in found.items():
        alone = charts.box(sales.filter(F.col("g") == grp), "v").first()
        assert (r["value"], r["low"], r["high"]) == (alone["value"], alone["low"], alone["high"])
        assert np.allclose([r["q1"], r["median"], r["q3"]], [alone["q1"], alone["median"], alone["q3"]])


def test_moments_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4)) * [1, 1e-3, 1e6, 1] + [1e9, 0, -5, 0]
    x[:, 3] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:300, 1] = np.nan  # a part without any row of a pair
    total = None
    for part in np.split(x, [300, 301, 650]):
        moved = moments.batch_moments(part)
        total = moved if total is None else moments.joined(total, moved)
    for a in range(4):
        for b in range(4):
            both = x[~np.isnan(x[:, a]) & ~np.isnan(x[:, b])][:, [a, b]]
            centred = both - both.mean(0)
            want = [len(both), both[:, 0].mean(), both[:, 1].mean(), *(centred**2).sum(0), (centred[:, 0] * centred[:, 1]).sum()]
            assert np.allclose([m[a, b] for m in total], want, rtol=1e-6, atol=1e-6 * (1 + abs(want[3]) ** 0.5 * abs(want[4]) ** 0.5))


def test_heatmap_far_from_zero_and_without_spread(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 2))
    rows = [(1e9 + float(a), float(0.5 * a + b), 3.0, None if i % 2 else float(b), None) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "p double, q double, flat double, half double, nothing double").repartition(6)
    cells = {(r["x"], r["grp"]): r["value"] for r in charts.heatmap(df, df.columns, digits=6).collect()}
    assert cells["p", "q"] == pytest.approx(np.corrcoef(x[:, 0], 0.5 * x[:, 0] + x[:, 1])[0, 1], abs=1e-5)
    assert cells["flat", "p"] is None and cells["half", "half"] == 1.0 and not any("nothing" in k for k in cells)
    assert cells["half", "q"] == pytest.approx(np.corrcoef(x[::2, 1], (0.5 * x[:, 0] + x[:, 1])[::2])[0, 1], abs=1e-5)
    assert charts.heatmap(df.limit(0), ["p", "q"]).count() == 0


def test_group_quantiles_order_values_by_one_sort(spark):
    """Brackets of few values are ordered where their group lies; no hash table or join sort holds all values."""
    values = spark.range(1_000).select((F.col("id") % 50).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    small = spark.range(50).select(F.col("id").cast("string").alias("g"), F.lit(3).alias("rank"), F.col("id").cast("double").alias("low"), (F.col("id") + 950.0).alias("high"), F.lit(3).alias("offset"))
    found = group_quantiles._ordered(values, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Window") == 1
    assert not [line for line in plan.splitlines() if "Aggregate(" in line and " v#" in line.split("functions=")[0]]
    assert sorted(tuple(r) for r in found.collect()) == sorted((str(i), 3, i + 150.0) for i in range(50))
