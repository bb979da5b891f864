import datetime as dt

import pytest
from pyspark.sql import functions as F

from petrel.functions.rounding import exact_round, round4
from petrel.functions.text import clean, is_placeholder, slug, split_objects, strip
from petrel.functions.time import generic_timestamp, ocel_timestamp


def one(spark, expression, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in df.select("k", expression(F.col("v")).alias("out")).orderBy("k").collect()]


def test_title_case_follows_letters_not_blanks(spark):
    got = one(spark, clean, "feat(core)", "purchase_order", "3rd", "o'neil", "  a\tb  c ", "ÉTÉ große", "\x01")
    assert got == ["Feat(Core)", "Purchase_Order", "3Rd", "O'Neil", "A B C", "Été Große", ""]


def test_strip_knows_unicode_white_space(spark):
    assert one(spark, strip, "  x ", "\x1c\x1fy\n", "") == ["x", "y", ""]


def test_placeholders(spark):
    assert one(spark, is_placeholder, " N/A ", "None", "--", "x", "tbd", "-x") == [True, True, True, False, True, False]


def test_object_cells(spark):
    got = one(spark, split_objects, "Order|Item", '["A", "B", null]', "['A', 'B']", " a ;; b,", None, "")
    assert got == [["Order", "Item"], ["A", "B", "None"], ["['A'", "'B']"], ["a", "b"], ["None"], []]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-1-2 3:04", dt.datetime(2024, 1, 2, 3, 4)),
        ("2024-01-02T03:04:05.250", dt.datetime(2024, 1, 2, 3, 4, 5, 250000)), ("03/04/2024", dt.datetime(2024, 4, 3)), ("03/25/2024", dt.datetime(2024, 3, 25)),
        ("31-12-2023", dt.datetime(2023, 12, 31)), ("2024-01-02T03:04:05.000Z", None), ("2024-02-30", None), ("soon", None), ("2024-01-02T03:04:05+02:00", None),
    ],
)
def test_generic_timestamps(spark, text, want):
    assert one(spark, generic_timestamp, text) == [want]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-02T03:04:05.000Z", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05+02:00", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05+0200", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02", None), ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ],
)
def test_ocel_timestamps(spark, text, want):
    assert one(spark, ocel_timestamp, text) == [want]


def test_rounding(spark):
    values = [0.62895, 0.00005, 0.12345, 1.0, 2 / 3]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    rows = df.select("k", exact_round(F.col("v")).alias("e"), round4(F.col("v")).alias("r")).orderBy("k").collect()
    assert [r.e for r in rows] == [round(v, 4) for v in values]
    assert rows[4].r == 0.6667


def test_slug(spark):
    assert one(spark, slug, "E-Commerce (Order)!") == ["e_commerce_order"]
