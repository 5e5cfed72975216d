"""Aggregates whose columns the warehouse declares: careers, ranks, rates."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The summed columns of a career, and its per-game rates.
CAREER_SUMS = (
    "gp w l min fgm fga fg3m fg3a ftm fta oreb dreb reb ast tov stl blk blka pf pfd pts "
    "plus_minus nba_fantasy_pts dd2 td3"
).split()
CAREER_RATES = {
    "career_w_pct": ("total_w", "total_gp"),
    "career_fg_pct": ("total_fgm", "total_fga"),
    "career_fg3_pct": ("total_fg3m", "total_fg3a"),
    "career_ft_pct": ("total_ftm", "total_fta"),
    "career_ppg": ("total_pts", "total_gp"),
    "career_rpg": ("total_reb", "total_gp"),
    "career_apg": ("total_ast", "total_gp"),
    "career_spg": ("total_stl", "total_gp"),
    "career_bpg": ("total_blk", "total_gp"),
    "career_topg": ("total_tov", "total_gp"),
}
SHOTS = {"fg_pct": ("fgm", "fga"), "fg3_pct": ("fg3m", "fg3a"), "ft_pct": ("ftm", "fta")}
DOUBLE_STATS = ["pts", "reb", "ast", "stl", "blk"]


def _ratio(top: str, bottom: str) -> Column:
    return F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))


def career_totals(totals: DataFrame) -> DataFrame:
    """One row per player from season totals; statistics not present are left out."""
    sums = [c for c in CAREER_SUMS if c in totals.columns]
    career = totals.groupBy("player_id").agg(
        F.count_distinct("season_id").cast("int").alias("seasons_played"),
        *[F.sum(F.col(c).cast("double")).alias(f"total_{c}") for c in sums],
        F.min("season_id").alias("first_season"),
        F.max("season_id").alias("last_season"),
    )
    rates = {
        name: _ratio(top, bottom)
        for name, (top, bottom) in CAREER_RATES.items()
        if {top, bottom} <= set(career.columns)
    }
    return career.withColumns(rates)


# Ranks are computed over distinct values, in value ranges whose width grows with the
# value: 64 per octave, so a range holds at most 2**17 distinct 4-byte floats.
_RANGES_PER_OCTAVE = 64


# Infinite values stand outside the ranges of all finite ones, NaN above every number.
_INFINITE, _NAN = 2**29, 2**30


def _value_range(value: Column, descending: Column) -> Column:
    """A range number that never decreases as the value grows.

    ``value`` has its sign turned where ``descending``; NaN has none and so goes first there.
    """
    size = F.log2(F.abs(value) + 1) * _RANGES_PER_OCTAVE
    infinite = F.abs(value) == float("inf")
    return (
        F.when(F.isnan(value), F.when(descending, -_NAN).otherwise(_NAN))
        .when(infinite, F.when(value > 0, _INFINITE).otherwise(-_INFINITE))
        .otherwise(F.floor(F.signum(value) * size).cast("int"))
    )


def rank_values(
    values: DataFrame, groups: Sequence[str], value: str, descending: Column
) -> DataFrame:
    """SQL ``rank()`` of each distinct value in its group; NULLs rank as PostgreSQL has it.

    A plain window would sort a whole group in one task. Here rows are first counted
    per distinct value, then numbered inside value ranges and shifted by the rows in
    the ranges before: a task sees one range of distinct values.
    """
    # Turning the value's sign for a descending rank lets one ascending pass do both.
    sort_value = F.when(descending, -F.col(value).cast("double")).otherwise(
        F.col(value).cast("double")
    )
    missing_first = F.when(descending, F.lit(-(2**31))).otherwise(F.lit(2**31 - 1))
    counted = values.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    ranged = counted.withColumn("_sort", sort_value).withColumn(
        "_range", F.coalesce(_value_range(F.col("_sort"), descending), missing_first.cast("int"))
    )
    null_place = F.when(F.col("_sort").isNotNull(), 1).when(descending, 0).otherwise(2)
    in_range = (
        Window.partitionBy(*groups, "_range")
        .orderBy(null_place, "_sort")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*groups)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*groups, "_range")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(across), F.lit(0)))
        .drop("_n")
    )
    within = F.coalesce(F.sum("_n").over(in_range), F.lit(0))
    return (
        ranged.withColumn("_within", within)
        .join(offsets, [*groups, "_range"])
        .select(*groups, value, (F.col("_offset") + F.col("_within") + 1).alias("rank"))
    )


def season_ranks(
    totals: DataFrame, stats: Sequence[str], ascending: Collection[str] = ()
) -> DataFrame:
    """``<stat>_rank`` of every player within the season, largest first by default.

    ``totals`` is read twice: pass a stored table.
    """
    keys = ["player_id", "season_id"]
    long = totals.select(*keys, *[F.col(s).cast("double").alias(s) for s in stats]).unpivot(
        keys, list(stats), "stat", "value"
    )
    descending = ~F.col("stat").isin(list(ascending)) if ascending else F.lit(True)
    ranks = rank_values(long, ["season_id", "stat"], "value", descending)
    same = reduce(
        lambda a, b: a & b,
        [
            F.col("l.season_id") == F.col("r.season_id"),
            F.col("l.stat") == F.col("r.stat"),
            F.col("l.value").eqNullSafe(F.col("r.value")),
        ],
    )
    ranked = long.alias("l").join(ranks.alias("r"), same).select("l.*", "r.rank")
    # One plain aggregate: a pivot groups twice, first by statistic as well.
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("stat") == s, F.col("rank"))).cast("int").alias(f"{s}_rank") for s in stats]
    )


def shooting_pcts(df: DataFrame) -> DataFrame:
    """Made over attempted for the shot types present; NULL without attempts."""
    present = {n: ab for n, ab in SHOTS.items() if set(ab) <= set(df.columns)}
    return df.withColumns({n: _ratio(*ab) for n, ab in present.items()})


def season_totals(log: DataFrame) -> DataFrame:
    """Season totals rebuilt from game logs, with shooting rates."""
    fixed = {"player_id", "game_id", "team_id", "season_id", "wl"}
    sums = [c for c in log.columns if c not in fixed and not c.endswith("_pct")]
    won, lost = F.col("wl") == "W", F.col("wl") == "L"
    totals = log.groupBy("player_id", "season_id").agg(
        F.count("*").cast("int").alias("gp"),
        F.count_if(won).cast("int").alias("w"),
        F.count_if(lost).cast("int").alias("l"),
        *[F.sum(F.col(c).cast("double")).alias(c) for c in sums],
    )
    return shooting_pcts(totals.withColumn("w_pct", _ratio("w", "gp")))


def per_game(totals: DataFrame, stats: Sequence[str] = ("pts", "reb", "ast")) -> DataFrame:
    """Per-game averages from season totals."""
    keys = [c for c in ("player_id", "season_id", "team_id") if c in totals.columns]
    return totals.select(*keys, "gp", *[_ratio(s, "gp").alias(s) for s in stats])


def double_double(log: DataFrame, stats: Sequence[str] = DOUBLE_STATS) -> DataFrame:
    """``dd2`` and ``td3``: two, three or more statistics of at least ten."""
    tens = reduce(
        lambda a, b: a + b,
        [F.coalesce((F.col(s) >= 10).cast("int"), F.lit(0)) for s in stats],
    )
    return log.withColumns(
        {"dd2": (tens >= 2).cast("int"), "td3": (tens >= 3).cast("int")}
    )
