"""Season ranks of unusual values."""

import math

import pytest

from courtside.operators.aggregates import rank_values, season_ranks
from pyspark.sql import functions as F

VALUES = [5.0, math.nan, -3.0, 10.0, math.inf, -math.inf, 0.0, 0.0, None, 1e30, math.nan]


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_match_a_window(spark, descending):
    df = spark.createDataFrame([("g", v) for v in VALUES], "g string, v double")
    got = {
        (repr(r.v), r["rank"]) for r in rank_values(df, ["g"], "v", F.lit(descending)).collect()
    }
    order = "v DESC NULLS FIRST" if descending else "v ASC NULLS LAST"
    window = df.selectExpr("v", f"rank() OVER (PARTITION BY g ORDER BY {order}) AS r")
    assert got == {(repr(r.v), r.r) for r in window.collect()}


def test_season_ranks_of_nan_and_infinity(spark):
    rows = [(i, 1, v) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "player_id int, season_id int, pts double")
    ranks = {r.player_id: r.pts_rank for r in season_ranks(df, ["pts"]).collect()}
    assert ranks[8] == 1 and ranks[1] == ranks[10] == 2 and ranks[4] == 4 and ranks[5] == 11
