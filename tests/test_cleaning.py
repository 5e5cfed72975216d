import math

import pytest
from pyspark.sql import functions as F

from courtside.functions import cleaning as c
from courtside.operators.integrity import domain_violations
from courtside.schemas import INT_COLUMNS, RANKED_STATS, TABLES
from courtside.sources.files import clean_row


def apply(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_safe_int(spark):
    texts = ["", "abc", "12.5", " 12 ", None, "-3", "2147483648"]
    assert apply(spark, c.safe_int("x"), texts) == [None, None, None, 12, None, -3, None]
    numbers = [12.7, -12.7, math.nan, None, 1e12]
    assert apply(spark, c.safe_int("x"), numbers, "double") == [12, -12, None, None, None]


def test_safe_float_keeps_nan_and_refuses_java_spellings(spark):
    texts = ["1.5", " 2 ", "", "x", None, "1d", "1F", "0x1p3", "inf", "1e3"]
    got = apply(spark, c.safe_float("x"), texts)
    assert got == [1.5, 2.0, None, None, None, None, None, None, math.inf, 1000.0]
    assert math.isnan(apply(spark, c.safe_float("x"), ["NaN"])[0])


def test_height_to_inches(spark):
    heights = ["6-5", "6-5-3", "72", "abc-5", "-5", "", None, "6-x", "6-"]
    want = [77, 77, None, None, None, None, None, None, None]
    assert apply(spark, c.height_to_inches("x"), heights) == want


def test_season_to_int(spark):
    labels = ["2023-24", "2023", "x", "", None, "-5", "9999999999", "2147483647"]
    assert apply(spark, c.season_to_int("x"), labels) == [22023, 22023, 0, 0, 0, 0, 0, 0]


def test_season_from_end_year(spark):
    got = apply(spark, c.season_from_end_year("x"), [2023, 2018, 2008], "int")
    assert got == [22022, 22017, 22007]


def test_blanks(spark):
    texts = ["", " ", "\t\n", " 　", "\x1c", " a ", "é", None]
    want = [None, None, None, None, None, " a ", "é", None]
    assert apply(spark, c.blank_to_null("x"), texts) == want
    from pyspark.sql.types import DoubleType

    got = apply(spark, c.blank_to_null("x", DoubleType()), [math.nan, 1.0], "double")
    assert got == [None, 1.0]


def test_strip_forms_agree(spark):
    texts = [" a ", "a", " b\x1f", "é ", " ", "", None, "a\tb", "é"]
    want = [t if t is None else t.strip() for t in texts]
    assert apply(spark, c.strip("x"), texts) == want
    assert apply(spark, c.strip_plain("x"), texts) == want


def test_na_and_stringify(spark):
    texts = ["NA", "null", "", "None", "na", None, "#N/A"]
    assert apply(spark, c.na_to_null("x"), texts) == [None] * 4 + ["na", None, None]
    assert apply(spark, c.stringify("x"), ["", None, "7"]) == [None, None, "7"]
    assert apply(spark, c.stringify("x", True), ["", None, "7"]) == [None, "None", "7"]


def test_clean_row(spark):
    df = spark.createDataFrame(
        [("12.7", " ", 1), ("abc", "Bo", 2), ("NA", "null", 3), ("9e99", "Al", 4)],
        "player_id string, player_name string, _arrival int",
    )
    rows = clean_row(df, TABLES["player"]).orderBy("_arrival").collect()
    assert [(r.player_id, r.player_name, r._reasons) for r in rows] == [
        (12, None, []),
        (None, "Bo", ["player_id: not a valid int"]),
        (None, None, []),
        (None, "Al", ["player_id: not a valid int"]),
    ]
    extra = clean_row(df.withColumn("nick", F.lit("x")), TABLES["player"])
    assert {r._reasons[-1] for r in extra.collect()} == {"unknown column: nick"}


def test_integer_columns_are_the_declared_ones():
    assert len(INT_COLUMNS) == 55
    assert len(RANKED_STATS) == 29
    assert len(TABLES["player_general_traditional_total"].columns) == 66
    assert len(TABLES["player_game_log"].columns) == 28
    assert len(TABLES["player_season"].columns) == 18
    assert len(TABLES["player_career_totals"].columns) == 39
    assert len(TABLES["play_by_play"].columns) == 18


@pytest.mark.parametrize(
    ("wl", "team", "want"),
    [
        ("W", "5", []),
        ("WL", "5", ["wl: too long"]),
        ("W", "99999999999", ["team_id: not a valid int"]),
        ("WL", "x", ["team_id: not a valid int", "wl: too long"]),
    ],
)
def test_domain_violations(spark, wl, team, want):
    df = spark.createDataFrame([(wl, team)], "wl string, team_id string")
    rows = domain_violations(df, TABLES["player_game_log"]).collect()
    assert [r._reasons for r in rows] == ([want] if want else [])


def test_clean_row_refuses_numbers_a_real_cannot_hold(spark):
    texts = ["1e39", "inf", "-1e39", "30.5", None, "x"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "pts string, _arrival int")
    rows = clean_row(df, TABLES["player_game_log"]).orderBy("_arrival").collect()
    assert [r.pts for r in rows] == [None, math.inf, None, 30.5, None, None]
    bad = ["pts: not a valid float"]
    assert [r._reasons for r in rows] == [bad, [], bad, [], [], bad]
