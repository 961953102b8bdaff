import random

import pytest

from pyspark.sql import functions as F

from tablewise.operators import joins, key_search, relate
from tablewise.operators.profile import profile_table
from tablewise.plans import generated


@pytest.fixture(scope="module")
def shop(spark):
    orders = [(f"o{i}", f"c{i % 25}", float(i)) for i in range(60)]
    customers = [(f"c{i}", "Rome" if i % 2 else "Oslo") for i in range(20)]
    items = [(f" o{i % 50} ", f"p{i % 11}") for i in range(120)]
    return {
        "s_orders": spark.createDataFrame(orders, "order_id string, customer_id string, revenue double"),
        "s_customers": spark.createDataFrame(customers, "customer_id string, city string"),
        "s_items": spark.createDataFrame(items, "order_id string, product_id string"),
    }


def profiles(tables):
    return {t: profile_table(df, t, samples=False) for t, df in tables.items()}


def test_listed_relationships(shop):
    found = {(r.from_table, r.to_table): r for r in relate.detect_relationships(shop, profiles(shop))}
    assert found["s_orders", "s_customers"].match_percent == 80.0
    assert found["s_orders", "s_customers"].confidence == "high"
    assert found["s_orders", "s_items"].match_percent == 83.33
    assert found["s_orders", "s_customers"].view_name == "view_s_orders_customers"
    assert [r.match_percent for r in relate.detect_relationships(shop, profiles(shop))] == [83.33, 80.0]


def test_contained_relationships_point_to_the_key(shop):
    found = relate.detect_relationships(shop, profiles(shop), orient="contained")
    links = {(r.from_table, r.to_table): r.match_percent for r in found}
    assert links["s_items", "s_orders"] == 100.0
    assert links["s_customers", "s_orders"] == 100.0


def test_no_pairs(spark, shop):
    only = {"s_orders": shop["s_orders"]}
    assert relate.detect_relationships(only, profiles(only)) == []


def test_many_id_columns_use_several_mask_words(spark):
    columns = [f"k{i}" for i in range(40)]
    rows = [tuple(f"v{i}_{j}" for j in range(40)) for i in range(10)]
    a = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    b = spark.createDataFrame(rows[:5], ", ".join(f"{c} string" for c in columns))
    pairs = [(("a", c), ("b", c)) for c in columns]
    got = relate.key_overlap({"a": a, "b": b}, pairs).collect()
    assert len(got) == 40 and all((r["from_keys"], r["to_keys"], r["shared"]) == (10, 5, 5) for r in got)


def test_join_view_keeps_left_rows_and_new_columns(shop):
    view = joins.join_view(shop["s_orders"], shop["s_customers"], "customer_id", "customer_id")
    assert view.columns == ["order_id", "customer_id", "revenue", "city"]
    assert view.count() == 60 and view.filter("city IS NULL").count() == 10


def links(*ends):
    return [relate.Relationship(a, ac, b, bc, "high", 100.0, f"view_{a}_{b}") for a, ac, b, bc in ends]


def test_master_views(spark):
    fact = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, d string")
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    right = spark.createDataFrame([("x", 9), ("x", 8)], "d string, m int")
    tables = {"s_fact": fact, "s_left": left, "s_right": right}
    rels = links(("s_fact", "k", "s_left", "k"), ("s_fact", "d", "s_right", "d"))
    assert joins.star(rels)[0] == "s_fact"
    repeated = sorted(tuple(r) for r in joins.master_fact_rows(tables, rels).collect())
    assert repeated[:5] == [("a", "x")] * 4 + [("b", "y")] and repeated[5:] == [("c", None)]
    once = joins.master_enriched(tables, rels)
    assert once.columns == ["k", "d", "left_n", "right_m"]
    assert sorted(tuple(r) for r in once.collect()) == [("a", "x", 1, 8), ("b", "y", 3, None), ("c", None, None, None)]


def test_hot_key_copies_are_made_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(joins, "COPIES_PER_ROW", 7)
    fact = spark.createDataFrame([("a",), ("b",)], "k string")
    many = spark.createDataFrame([("a",)] * 50 + [("b",)] * 7, "k string")
    out = joins.master_fact_rows({"s_f": fact, "s_m": many}, links(("s_f", "k", "s_m", "k")))
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 50, "b": 7}


def test_create_join_views(spark, shop):
    found = relate.detect_relationships(shop, profiles(shop))
    low = relate.Relationship("s_orders", "order_id", "s_items", "product_id", "low", 10.0, "view_low")
    result = joins.create_join_views("abcd1234-x", shop, [*found, low])
    assert result.master_name == "master_view_abcd1234" and not result.errors
    assert spark.table("view_s_orders_customers").count() == 60
    assert any(line.startswith("left out, too uncertain") for line in result.log)
    broken = relate.Relationship("s_orders", "nope", "s_customers", "customer_id", "high", 90.0, "view_broken")
    assert joins.create_join_views("abcd1234-x", shop, [broken]).errors
    assert joins.create_join_views("x", shop, []).log == ["no table refers to another; no views are built"]


def test_generated_views_are_named_per_table(spark, shop):
    types = {
        "s_orders": {"order_id": "id", "customer_id": "id", "revenue": "currency"},
        "s_customers": {"customer_id": "id", "city": "category"},
    }
    views = generated.generated_views("feed0001", {t: shop[t] for t in types}, types)
    assert sorted(views) == ["v_feed0001_customers_summary", "v_feed0001_orders_entity_summary", "v_feed0001_orders_summary"]
    assert generated.list_views(spark, "feed0001") == sorted(views)
    assert views["v_feed0001_orders_entity_summary"].count() == 25


def test_shares_sum_to_a_hundred(shop):
    rows = generated.by_category(shop["s_orders"], "customer_id", "revenue").collect()
    assert abs(sum(float(r["value_share_pct"]) for r in rows) - 100) < 0.2


def test_hot_key_fills_all_tasks(spark):
    """95 % of the fact rows have one key, whose linked rows repeat them."""
    fact = spark.range(20_000).selectExpr("id", "if(id % 20 = 0, id, 7) k")
    many = spark.range(1_000).selectExpr("if(id < 3, 7, id) k", "id v")
    out = joins.master_fact_rows({"s_f": fact, "s_m": many}, links(("s_f", "k", "s_m", "k")))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 50_000 and max(sizes) < 2 * sum(sizes) / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_key_search_loses_no_pair(spark):
    """All ordered pairs of columns against the exact shares, with sketches much smaller than the columns."""
    rng = random.Random(9)
    held = {f"t{i}": {"k": rng.sample(range(3000), rng.choice([5, 40, 900, 2500])), "m": rng.sample(range(200), 30)} for i in range(6)}
    held["t6"] = {"k": [7], "m": []}
    rows = {t: [(c.get("k")[i] if i < len(c["k"]) else None, c["m"][i] if i < len(c["m"]) else None) for i in range(max(len(c["k"]), len(c["m"])))] for t, c in held.items()}
    tables = {t: spark.createDataFrame([(a, None if b is None else f" {b}") for a, b in r], "k long, m string") for t, r in rows.items()}
    want = {}
    for t, own in held.items():
        for u, other in held.items():
            for c in own:
                for d in other:
                    if t != u and own[c] and 2 * len(set(own[c]) & set(other[d])) >= len(own[c]):
                        want[t, c, u, d] = len(set(own[c]) & set(other[d]))
    for sketch in (64, 4000):
        found = key_search.containments(tables, {t: ["k", "m"] for t in held}, sketch=sketch).collect()
        assert {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]): r["shared"] for r in found} == want
    assert 0.25 < key_search.slack(64) < 0.5 and key_search.slack(256) < 0.25
