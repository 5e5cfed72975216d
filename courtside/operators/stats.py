"""Questions on the warehouse. ``t`` maps table names to DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.cleaning import season_from_end_year

Tables = Mapping[str, DataFrame]
TOTALS = "player_general_traditional_total"


def _season(df: DataFrame, season_id: int) -> DataFrame:
    return df.filter(F.col("season_id") == season_id)


def _with_names(t: Tables, stats: DataFrame) -> DataFrame:
    return stats.join(t["player"].select("player_id", "player_name"), "player_id")


def top_players(t: Tables, table: str, stat: str, season_id: int, k: int = 5) -> DataFrame:
    """The ``k`` players with the most of a statistic in a season; ties by name."""
    stats = _season(t[table], season_id).select("player_id", stat)
    return (
        _with_names(t, stats)
        .orderBy(F.desc_nulls_first(stat), "player_name", "player_id")
        .limit(k)
        .select("player_name", stat)
    )


def count_players(t: Tables, table: str, predicate: Column, season_id: int) -> DataFrame:
    """How many rows of a season satisfy the predicate."""
    matching = _season(t[table], season_id).filter(predicate)
    return matching.agg(F.count("*").alias("num_players"))


def player_stat(t: Tables, player_name: str, stat: str, season_id: int) -> DataFrame:
    """One player's per-game statistic in one season."""
    player = t["player"].filter(F.col("player_name") == player_name).select("player_id")
    stats = _season(t["player_season"], season_id).select("player_id", stat)
    return stats.join(player, "player_id").select(stat)


def team_wins(
    t: Tables, season_id: int, k: int = 1, distinct_games: bool = False
) -> DataFrame:
    """Teams by winning player rows, or by games won with ``distinct_games``."""
    won = _season(t["player_game_log"], season_id).filter(F.col("wl") == "W")
    names = t["team"].select("team_id", "nickname")
    if distinct_games:
        pairs = won.select("team_id", "game_id").distinct().join(names, "team_id")
        counted = pairs.groupBy("nickname").agg(F.count_distinct("game_id").alias("wins"))
    else:
        per_team = won.groupBy("team_id").agg(F.count("*").alias("n"))
        counted = (
            per_team.join(names, "team_id").groupBy("nickname").agg(F.sum("n").alias("wins"))
        )
    return counted.orderBy(F.desc("wins"), "nickname").limit(k)


def players_over(
    t: Tables, table: str, stat: str, threshold: float, season_id: int
) -> DataFrame:
    """Players above a threshold in a season, in no particular order."""
    stats = _season(t[table], season_id).filter(F.col(stat) > threshold)
    return _with_names(t, stats.select("player_id", stat)).select("player_name", stat)


def players_where(t: Tables, column: str, value: str) -> DataFrame:
    """Names of the players with a given attribute, sorted."""
    found = t["player"].filter(F.col(column) == value).select("player_name")
    return found.orderBy(F.asc_nulls_last("player_name"))


def best_per_team_season(t: Tables, stat: str = "pts", team: str | None = None) -> DataFrame:
    """Per season, the player(s) with their team's highest value; ties are kept.

    Every task keeps only the best of its team-seasons before the shuffle, and names are
    joined to what is left: the season table is read once.
    """
    teams = t["team"].select("team_id", "nickname")
    if team is not None:
        teams = teams.filter(F.col("nickname") == team)
    known = t["player_season"].filter(F.col(stat).isNotNull())
    if team is not None:
        known = known.join(teams.select("team_id"), "team_id", "left_semi")
    order = Window.partitionBy("team_id", "season_id").orderBy(F.desc(stat))
    best = known.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") == 1)
    totals = t[TOTALS].select("player_id", "season_id")
    leaders = best.join(totals, ["player_id", "season_id"], "left_semi").join(teams, "team_id")
    return (
        _with_names(t, leaders)
        .select("season_id", "nickname", "player_name", stat)
        .orderBy(F.asc_nulls_last("season_id"), "nickname", "player_name")
    )


def league_leaders(
    t: Tables, columns: Sequence[str], order_by: str = "pts", k: int = 10
) -> DataFrame:
    """Every season's top ``k`` players with chosen columns and the season's size.

    Rows that rank beyond ``k`` by value go before any name is joined; ties at the cut
    stay until names decide. Every stored statistic has a known player (K4).
    """
    by_value = Window.partitionBy("season_id").orderBy(F.desc_nulls_first(order_by))
    top = t[TOTALS].withColumn("_rank", F.rank().over(by_value)).filter(F.col("_rank") <= k)
    named = _with_names(t, top).join(
        t["team"].select("team_id", "abbreviation"), "team_id", "left"
    )
    order = Window.partitionBy("season_id").orderBy(
        F.desc_nulls_first(order_by), "player_name", "player_id"
    )
    leaders = named.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= k
    )
    sizes = t[TOTALS].groupBy("season_id").agg(F.count("*").alias("players"))
    return leaders.join(sizes, "season_id").select(
        "season_id", "place", "players", "player_name", "abbreviation", *columns
    )


def grouped_having(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], having: Column
) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs).filter(having)


def where_in(df: DataFrame, col: str, sub_df: DataFrame, sub_col: str) -> DataFrame:
    """``col IN (SELECT sub_col …)``."""
    return df.join(sub_df.select(F.col(sub_col).alias(col)), col, "left_semi").select(
        *df.columns
    )


def where_equals_extreme(df: DataFrame, col: str, func: str = "max") -> DataFrame:
    """``col = (SELECT MAX(col) …)``, or MIN."""
    extreme = {"max": F.max, "min": F.min}[func]
    return df.filter(F.col(col) == df.agg(extreme(col)).scalar())


def agg_suite(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    value = F.col(col).cast("double")
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"avg_{col}"),
        F.sum(value).alias(f"sum_{col}"),
        F.count(col).alias(f"count_{col}"),
        F.max(col).alias(f"max_{col}"),
        F.min(col).alias(f"min_{col}"),
    )


def null_split(df: DataFrame, col: str) -> DataFrame:
    """How many rows have the column missing and how many have it."""
    return df.agg(
        F.count_if(F.col(col).isNull()).alias("is_null"),
        F.count_if(F.col(col).isNotNull()).alias("is_not_null"),
    )


def in_end_year(df: DataFrame, year: int) -> DataFrame:
    """Rows of the season that ends in ``year``."""
    return df.filter(F.col("season_id") == season_from_end_year(year))


def _look_up(events: DataFrame, dim: DataFrame, column: str) -> DataFrame:
    """Left join of a dimension on one id; events without it are dealt out, not put together.

    Ids are 32-bit numbers. A missing one becomes a number beyond those, which no row of
    the dimension has, so a sorted join doesn't bring all of them to one task.
    """
    spread = F.lit(1 << 40) + F.pmod(F.xxhash64("game_id", "event_num"), F.lit(4096))
    marked = events.withColumn("_key", F.coalesce(F.col(column).cast("bigint"), spread))
    keyed = dim.withColumn(column, F.col(column).cast("bigint")).withColumnRenamed(column, "_key")
    return marked.join(keyed, "_key", "left").drop("_key")


def decode_events(t: Tables) -> DataFrame:
    """The event log with its type, player and team names.

    No broadcast is forced: Spark broadcasts a dimension whose size it knows to be
    under its threshold, and splits skewed keys of a sorted join at run time. Most events
    lack most ids; such rows get keys that match nothing and spread evenly.
    """
    events = t["play_by_play"]
    types = t["event_message_type"].select(
        F.col("id").alias("event_msg_type_id"), F.col("string").alias("event_type")
    )
    out = _look_up(events, types, "event_msg_type_id")
    lookups = [("player", "player_id", "player_name"), ("team", "team_id", "nickname")]
    for n in (1, 2, 3):
        for table, key, label in lookups:
            column = f"player{n}_id" if table == "player" else f"player{n}_team_id"
            if column in events.columns:
                dim = t[table].select(
                    F.col(key).alias(column),
                    F.col(label).alias(f"player{n}_name" if table == "player" else f"team{n}"),
                )
                out = _look_up(out, dim, column)
    return out
