import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewise.catalog.dirt import dirty_orders
from tablewise.operators import clean
from tablewise.operators.profile import profile_table
from tablewise.session import stage

SCHEMA = (
    "order_id string, order_date string, unit_price string, quantity string, status string, comment string,"
    " is_gift string"
)


def fixture_rows():
    dates = ["2024-01-15", "01/16/2024", "13/03/2025", "2024-02-01 10:00:00"]
    towns = ["north", "North", "NORTH ", "o'neil 3RD", "new-york", "\tSouth"]
    rows = [
        (
            f"o{i}", dates[i % 4], str(10 + i % 7) + ".5", str(1 + i % 5), towns[i % 6], None,
            ("yes", "no", None)[i % 3],
        )
        for i in range(52)
    ]
    rows[3] = rows[3][:2] + ("--",) + rows[3][3:]
    rows[4] = rows[4][:2] + (" 12.5 ",) + rows[4][3:]
    rows[5] = rows[5][:2] + ("99999",) + rows[5][3:]
    rows[6] = rows[6][:3] + ("?",) + rows[6][4:]
    rows[7] = ("N/A",) + rows[7][1:]
    rows[8] = (None,) + rows[8][1:]
    rows[9] = rows[9][:1] + ("unknown",) + rows[9][2:]
    blank = rows[10][:4] + (rows[10][4] + " ",) + rows[10][5:]
    return rows + [rows[0], rows[1], rows[2], blank]


def cleaned(spark, **options):
    df = spark.createDataFrame(fixture_rows(), SCHEMA)
    return clean.clean_table(df, "t", profile_table(df, "t"), **options)


def test_whole_table(spark):
    out = cleaned(spark, stage=stage)
    rows = {r["order_id"]: r for r in out.df.collect() if r["order_id"] != "o10"}
    assert out.original_rows == 56 and out.duplicate_rows == 3 and out.rows_removed == 5
    assert out.final_rows == out.df.count() == 51  # the copy that differs by a blank survives
    assert out.df.filter("order_id = 'o10'").count() == 2
    assert rows["o4"]["unit_price"] == 12.5
    assert rows["o3"]["unit_price"] == 13.5  # median
    assert rows["o6"]["quantity"] in (2.0, 3.0, 4.0)
    assert rows["o2"]["order_date"] == dt.datetime(2025, 3, 13)
    assert rows["o9"]["order_date"] is None
    assert {r["status"] for r in rows.values()} == {"North", "O'Neil 3Rd", "New-York", "South"}
    assert {r["comment"] for r in rows.values()} == {"Unknown"}
    assert {r["is_gift"] for r in rows.values()} == {True, False}
    assert rows["o5"]["is_outlier_unit_price"] is True and rows["o4"]["is_outlier_unit_price"] is False
    assert out.outlier_columns == 1
    steps = [e.step for e in out.log]
    assert steps == sorted(steps, key=["null_tokens", "coerce_numbers", "duplicates", "missing_ids", "impute", "dates", "strip", "title", "outliers"].index)
    assert any(e.level == "warning" and e.step == "dates" and e.affected == 1 for e in out.log)


def test_no_nulls_left_and_cleaning_twice_changes_nothing(spark):
    out = cleaned(spark)
    kept = [c for c in out.df.columns if c not in ("order_date",)]
    assert out.df.filter(" OR ".join(f"{c} IS NULL" for c in kept)).count() == 0
    assert clean.drop_duplicates(out.df).count() == clean.drop_duplicates(clean.drop_duplicates(out.df)).count()


def test_normalise_first_removes_blank_variants(spark):
    assert cleaned(spark, normalise_first=True).duplicate_rows == 4


def test_unknown_flags_stay_text(spark):
    df = spark.createDataFrame([("maybe",), ("yes",), (None,)], "is_open string")
    out = clean.clean_table(df, "t", profile_table(df, "t")).df
    assert sorted(r[0] for r in out.collect()) == ["False", "maybe", "yes"]


def test_mode_prefers_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "region string")
    assert clean.imputation_values(df, {"region": "category"}, ["region"]) == {"region": "a"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=40))
def test_median_fill_property(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values], "amount long")
    fills = clean.imputation_values(df, {"amount": "currency"}, ["amount"])
    known = [v for v in values if v is not None]
    assert fills == ({"amount": float(statistics.median(known))} if known else {})
    out = clean.impute(df, {"amount": "currency"}, fills)
    assert out.filter("amount IS NULL").count() == (0 if known else len(values))


def test_dirty_orders_keep_every_order(spark, folder):
    df = dirty_orders(spark, folder)
    assert df.count() >= 1500
    out = clean.clean_table(df, "dirty", profile_table(df, "dirty", samples=False))
    assert out.rows_removed == out.duplicate_rows + sum(e.affected for e in out.log if e.step == "missing_ids")
