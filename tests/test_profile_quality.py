import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import profile as prof
from tablewise.operators import profile_state, quality
from tablewise.operators.quantiles import exact_quantiles


def types(spark, **columns):
    rows = list(zip(*columns.values()))
    kinds = {int: "long", float: "double", bool: "boolean", str: "string"}

    def kind(values):
        return kinds[type(next(v for v in values if v is not None))] if any(v is not None for v in values) else "string"

    schema = ", ".join(f"`{n}` {kind(v)}" for n, v in columns.items())
    return prof.types_of(prof.profile_table(spark.createDataFrame(rows, schema), "t"))


def test_texts_that_are_numbers_dates_and_flags(spark):
    found = types(
        spark,
        Quantity=["5.0", "1.0", "3.0"] * 10,
        Unit_Price=["255.96", "514.01", "173.91"] * 10,
        Delivery_Date=["12/05/2023", "11/08/2024", "13/03/2025"] * 10,
        Is_Returning_Customer=["yes", "no", "true"] * 10,
        choice=["Y", "n", " y"] * 10,
        empty=[None] * 30,
        town=["Rome", "Oslo", "Bern"] * 10,
    )
    assert found == {
        "Quantity": "numeric", "Unit_Price": "currency", "Delivery_Date": "datetime",
        "Is_Returning_Customer": "boolean", "choice": "boolean", "empty": "text", "town": "category",
    }


def test_numbers(spark):
    n = 200
    found = types(
        spark,
        row=list(range(1, n + 1)),
        order_key=[i * 1000 + 17 for i in range(n)],
        flag01=[i % 2 for i in range(n)],
        amount=[i % 7 for i in range(n)],
        measure=[i / 8 + 2 for i in range(n)],
        share=[(i % 90) / 100 for i in range(n)],
        level=[i % 9 + 3 for i in range(n)],
        ok=[i % 3 == 0 for i in range(n)],
    )
    assert found == {
        "row": "id", "order_key": "id", "flag01": "boolean", "amount": "currency", "measure": "currency",
        "share": "numeric", "level": "numeric", "ok": "boolean",
    }


def test_text_ids(spark):
    n = 300
    found = types(
        spark,
        order_id=[f"o{i}" for i in range(n)],
        seller_id=[f"s{i % 20}" for i in range(n)],
        few_id=[f"s{i % 5}" for i in range(n)],
        token=[f"x-{i}-y" for i in range(n)],
        words=[f"w{i % 100}" for i in range(n)],
    )
    assert found == {"order_id": "id", "seller_id": "id", "few_id": "category", "token": "id", "words": "text"}


def test_profile_counts_and_samples(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 0.0), ("b", -0.0), ("a", None)], "t string, v double")
    t, v = prof.profile_table(df, "x")
    assert (t.null_count, t.null_percent, t.unique_count, t.sample_values) == (1, 25.0, 2, ("a", "b", "a"))
    assert (v.null_count, v.unique_count, v.column_order) == (1, 2, 1)
    assert prof.profile_table(df.limit(0), "none")[0].detected_type == "text"


def test_long_texts_are_compared_whole(spark):
    same, other = "x" * 5000, "x" * 4999 + "y"
    df = spark.createDataFrame([(same,), (same,), (other,)], "t string")
    assert prof.profile_table(df, "x")[0].unique_count == 2
    assert quality.duplicate_count(df).first()["duplicate_rows"] == 1


@pytest.mark.parametrize("limit", [1, 5, 50, 10_000])
def test_exact_quantiles_at_any_limit(spark, limit):
    rng = np.random.default_rng(1)
    skewed = np.concatenate([np.full(700, 3.0), rng.lognormal(0, 3, 900), np.full(400, -1e6)])
    rng.shuffle(skewed)
    df = spark.createDataFrame([(float(x), None) for x in skewed] + [(None, None)], "a double, b double")
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0)
    found = exact_quantiles(df.repartition(5), {"a": F.col("a"), "b": F.col("b")}, probs, limit=limit)
    assert found["a"].count == len(skewed)
    assert np.allclose(found["a"].values, np.quantile(skewed, probs), rtol=1e-12)
    assert found["b"].count == 0 and found["b"].values[0] is None


def report(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return quality.quality_report(df, "t", prof.profile_table(df, "t")).first()


def test_quality_report(spark):
    rows = [(f"o{i}", float(i % 9), None if i % 3 == 0 else "x", None) for i in range(40)]
    rows += [("big", 9999.0, "x", None), ("big", 9999.0, "x", None)]
    r = report(spark, rows, "order_id string, level double, note string, empty string")
    # duplicates 15, nulls beyond 30 % 15, all null 10, outliers 5
    assert (r["duplicate_rows"], r["columns_with_nulls"], r["outlier_columns"]) == (1, 2, 1)
    assert r["quality_score"] == 100 - 15 - 15 - 10 - 5
    assert r["summary"].startswith("Quality: moderate, 55 of 100 points. Found: 1 repeated rows, 2 columns")
    assert r["issues_found"][0] == "1 rows repeat others (2.4%)"
    assert [i["issue_type"] for i in r["column_issues"]] == ["nulls", "all_null", "outliers"]


def test_clean_table_scores_full(spark):
    r = report(spark, [(i, float(i % 7)) for i in range(30)], "id long, level double")
    assert r["quality_score"] == 100 and r["summary"].endswith("Nothing was found.")


def test_mixed_type_points(spark):
    rows = [(str(i % 8),) for i in range(99)] + [("?",)]
    assert report(spark, rows, "quantity string")["issues_found"][-1].startswith("quantity mixes numbers")


def test_percents_are_told_by_their_exact_value(spark):
    """0.85 as a double is a little less than 85 hundredths; 6.25 lies halfway."""
    measured = spark.createDataFrame(
        [(0, "a", "numeric", 625, 6.25, False, 85, 10_000, 25)], quality.COLUMN_SCHEMA
    )
    texts = {r["issue_type"]: r["description"] for r in quality.issue_rows(measured).collect()}
    assert texts["outliers"] == "a holds 85 extreme values (0.8%)"
    assert texts["nulls"] == "a lacks 625 values (6.2%)"
    assert texts["duplicates"] == "25 rows repeat others (0.2%)"


def test_outlier_notice(spark):
    reports = spark.createDataFrame([("orders", 2), ("customers", 0)], "table_name string, outlier_columns long")
    notice = quality.outlier_notice(reports).first()
    assert notice["message"] == "Values far from the rest were marked in orders (2 column(s))."
    assert quality.outlier_notice(reports.filter("outlier_columns = 0")).count() == 0


def test_search_and_summary(spark):
    df = spark.createDataFrame([("o1", "x", None), ("o2", "y", None)], "order_id string, status string, n string")
    frame = prof.profiles_to_frame(spark, {"orders": prof.profile_table(df, "orders")})
    assert [r["column_name"] for r in prof.search_fields(frame, " STATUS ").collect()] == ["status"]
    scores = spark.createDataFrame([("orders", 91, 10), ("x", 80, 5)], "table_name string, quality_score long, total_rows long")
    summary = prof.dataset_summary(frame, scores).first()
    assert (summary["tables"], summary["fields"], summary["total_rows"], summary["overall_quality"]) == (2, 3, 15, 85)
    assert summary["completeness"] == 66.67


def test_states_of_parts_are_the_state_of_the_whole(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["x", None, "12", " 3.5", "long " * 30]), rng.choice([None, -0.0, 1.5, 1e6]), f"v{rng.randrange(4000)}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, word string, amount double, many string")
    whole = {r["column_name"]: r for r in profile_state.profile_of(profile_state.column_state(df, "t")).collect()}
    parts = None
    for k in range(3):
        parts = profile_state.add_part(parts, df.filter(F.col("id") % 3 == k), "t")
    joined = {r["column_name"]: r for r in profile_state.profile_of(parts).collect()}
    assert joined == whole and set(whole) == {"id", "word", "amount", "many"}
    values = [r[3] for r in rows]
    assert abs(whole["many"]["distinct_estimate"] / len(set(values)) - 1) < 0.05  # three standard errors
    assert whole["many"]["samples"] == sorted(set(values), key=lambda v: hashlib.md5(v.encode()).digest())[:5]
    assert (whole["word"]["numbers"], whole["word"]["high"]) == (sum(r[1] in ("12", " 3.5") for r in rows), 12.0)
    assert whole["amount"]["null_count"] == sum(r[2] is None for r in rows)
    empty = profile_state.profile_of(profile_state.add_part(parts, df.limit(0), "t")).collect()
    assert {r["column_name"]: r for r in empty} == whole


def test_samples_look_at_few_values_of_many(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("t0"), (F.col("id") % 3).cast("string").alias("t1"))
    looked_at = profile_state._candidates(df, {0: profile_state.CANDIDATES / 20_000}).count()
    assert 5 <= looked_at <= 3 * profile_state.CANDIDATES
    want = [v for _, v in sorted((hashlib.md5(str(i).encode()).hexdigest(), str(i)) for i in range(20_000))[:5]]
    for estimate in (20_000, 2_000_000):  # of the latter's share too few are left at first
        samples = {r[0]: [s["value"] for s in r[1]] for r in profile_state._samples(df, {0: estimate, 1: 3}).collect()}
        assert samples[0] == want and sorted(samples[1]) == ["0", "1", "2"]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_duplicates_by_hash_and_by_digest(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW_HASHES", few)
    rows = [(i, None, "x", 0.0, [1.0]) for i in range(500)] + [(7, None, "x", -0.0, [1.0])] * 3 + [(None, 7, "x", 0.0, None)] * 2
    df = spark.createDataFrame(rows, "a long, b long, c string, d double, e array<double>")
    assert tuple(quality.duplicate_count(df).first()) == (505, 4)
    assert tuple(quality.duplicate_count(df.limit(0)).first()) == (0, 0)


def test_a_repeated_edge_is_counted_once(spark, monkeypatch):
    """Eight columns' quartiles took 128 counts of every row; now two for each different edge."""
    from tablewise.operators import quantiles

    counts, plain = [], quantiles.F.count_if
    monkeypatch.setattr(quantiles.F, "count_if", lambda test: counts.append(1) or plain(test))
    df = spark.range(5_000).select(*(((F.col("id") * (i + 7)) % 4999).cast("double").alias(f"c{i}") for i in range(8)))
    found = exact_quantiles(df, {c: F.col(c) for c in df.columns}, (0.25, 0.75), limit=100)
    assert all(q.count == 5_000 for q in found.values()) and len(counts) <= 96


def test_counted_values_have_narrow_keys(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS a, CAST(NULL AS timestamp_ntz) AS b FROM range(6)")
    assert dict(prof._counted(df).dtypes) == {"place": "int", "value": "timestamp_ntz", "n": "bigint"}
    stats = {r["column_name"]: (r["total_rows"], r["filled"], r["unique_count"]) for r in prof.column_stats(df).collect()}
    assert stats == {"a": (6, 6, 1), "b": (6, 0, 0)}


def test_nested_schema_tells_relationships_on_both_sides(spark):
    profiles = spark.createDataFrame(
        [("a", 0, "k", "id", 0, 0.0, 3), ("b", 1, "v", "text", 0, 0.0, 2), ("b", 0, "k", "id", 0, 0.0, 3), ("c", 0, "x", "text", 0, 0.0, 1)],
        "table_name string, column_order long, column_name string, detected_type string, null_count long, null_percent double, unique_count long",
    )
    links = spark.createDataFrame(
        [("a", "k", "b", "k", "high", 100.0, "view_a_b")],
        "from_table string, from_column string, to_table string, to_column string, confidence string, match_percent double, view_name string",
    )
    rows = {r["table_name"]: r for r in prof.nested_schema(profiles, relationships=links).collect()}
    assert [c["column_name"] for c in rows["b"]["columns"]] == ["k", "v"]
    assert rows["a"]["relationships"] == rows["b"]["relationships"] and rows["a"]["relationships"][0]["match_percent"] == 100.0
    assert rows["c"]["relationships"] == []
    assert "relationships" not in prof.nested_schema(profiles).columns
