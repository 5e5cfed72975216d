"""Questions on the warehouse, and the aggregates its schema declares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.catalogue import number, number_sql, query
from courtside.fixtures import LOG_STATS, PGTT, Views, with_views
from courtside.operators import aggregates, stats
from courtside.session import stored

SEASON = 21998
SHOWN = ["gp", "pts", "reb", "ast", "stl", "blk", "tov", "fg3a", "fg3_pct"]


def _top_sql(table: str, stat: str) -> str:
    return (
        with_views("player", table)
        + f"""SELECT p.player_name, {number_sql(f"s.{stat}", stat)}
FROM player p JOIN {table} s ON p.player_id = s.player_id
WHERE s.season_id = {SEASON} ORDER BY s.{stat} DESC NULLS FIRST, p.player_name, p.player_id LIMIT 5"""
    )


def _top(v: Views, table: str, stat: str) -> DataFrame:
    return stats.top_players(v, table, stat, SEASON).select("player_name", number(stat))


@query(_top_sql("player_season", "pts"))
def top_scorers(v: Views) -> DataFrame:
    return _top(v, "player_season", "pts")


@query(_top_sql(PGTT, "tov"))
def top_turnovers(v: Views) -> DataFrame:
    return _top(v, PGTT, "tov")


@query(_top_sql(PGTT, "pf"))
def top_fouls(v: Views) -> DataFrame:
    return _top(v, PGTT, "pf")


@query(_top_sql(PGTT, "blk"))
def top_blockers(v: Views) -> DataFrame:
    return _top(v, PGTT, "blk")


@query(
    with_views(PGTT)
    + f"""SELECT CAST(count(*) AS bigint) AS num_players FROM {PGTT}
WHERE season_id = {SEASON} AND CAST(fg3_pct AS double) > CAST(0.40 AS double)
  AND CAST(fg3a AS double) >= 30"""
)
def count_three_pt(v: Views) -> DataFrame:
    made = (F.col("fg3_pct").cast("double") > 0.40) & (F.col("fg3a") >= 30)
    return stats.count_players(v, PGTT, made, SEASON)


@query(
    with_views("player", "player_season")
    + f"""SELECT {number_sql("ps.pts", "pts")} FROM player_season ps
JOIN player p ON ps.player_id = p.player_id
WHERE p.player_name = 'red widget 1' AND ps.season_id = {SEASON}"""
)
def player_season_lookup(v: Views) -> DataFrame:
    return stats.player_stat(v, "red widget 1", "pts", SEASON).select(number("pts"))


@query(
    with_views("player_game_log", "team")
    + f"""SELECT t.nickname, CAST(count(*) AS bigint) AS wins FROM player_game_log g
JOIN team t ON g.team_id = t.team_id WHERE g.season_id = {SEASON} AND g.wl = 'W'
GROUP BY t.nickname ORDER BY wins DESC, t.nickname LIMIT 1"""
)
def team_wins(v: Views) -> DataFrame:
    return stats.team_wins(v, SEASON)


@query(
    with_views("player_game_log", "team")
    + f"""SELECT t.nickname, CAST(count(DISTINCT g.game_id) AS bigint) AS wins
FROM player_game_log g JOIN team t ON g.team_id = t.team_id
WHERE g.season_id = {SEASON} AND g.wl = 'W'
GROUP BY t.nickname ORDER BY wins DESC, t.nickname LIMIT 5"""
)
def team_wins_games(v: Views) -> DataFrame:
    return stats.team_wins(v, SEASON, k=5, distinct_games=True)


@query(
    with_views("player", "player_season")
    + f"""SELECT p.player_name, {number_sql("ps.pts", "pts")} FROM player_season ps
JOIN player p ON ps.player_id = p.player_id WHERE ps.season_id = {SEASON} AND ps.pts > 25"""
)
def threshold_players(v: Views) -> DataFrame:
    over = stats.players_over(v, "player_season", "pts", 25, SEASON)
    return over.select("player_name", number("pts"))


@query(
    with_views("player")
    + "SELECT player_name FROM player WHERE college = 'Brand#11' ORDER BY player_name"
)
def players_from_college(v: Views) -> DataFrame:
    return stats.players_where(v, "college", "Brand#11")


@query(
    with_views("player", "player_season", "team", PGTT)
    + f"""SELECT pg.season_id, t.nickname, p.player_name, {number_sql("ps.pts", "pts")}
FROM player p JOIN player_season ps ON p.player_id = ps.player_id
JOIN team t ON ps.team_id = t.team_id
JOIN {PGTT} pg ON p.player_id = pg.player_id AND ps.season_id = pg.season_id
WHERE ps.pts = (SELECT max(ps2.pts) FROM player_season ps2
  WHERE ps2.team_id = ps.team_id AND ps2.season_id = ps.season_id)
ORDER BY pg.season_id"""
)
def best_scorer_per_team_season(v: Views) -> DataFrame:
    best = stats.best_per_team_season(v)
    return best.select("season_id", "nickname", "player_name", number("pts"))


@query(
    with_views("player", "team", PGTT)
    + f"""SELECT season_id, place, players, player_name, abbreviation,
  {", ".join(number_sql(c) for c in SHOWN)}
FROM (SELECT g.*, p.player_name, t.abbreviation,
    CAST(row_number() OVER (PARTITION BY g.season_id
      ORDER BY g.pts DESC NULLS FIRST, p.player_name, p.player_id) AS int) AS place,
    CAST(count(*) OVER (PARTITION BY g.season_id) AS bigint) AS players
  FROM {PGTT} g JOIN player p ON g.player_id = p.player_id
  LEFT JOIN team t ON g.team_id = t.team_id) x
WHERE place <= 10"""
)
def league_leaders(v: Views) -> DataFrame:
    leaders = stats.league_leaders(v, SHOWN)
    return leaders.select(
        "season_id", "place", "players", "player_name", "abbreviation", *map(number, SHOWN)
    )


@query(
    with_views("player_game_log")
    + """SELECT team_id, season_id, CAST(count(*) AS bigint) AS games,
  round(avg(CAST(pts AS double)), 4) AS avg_pts
FROM player_game_log GROUP BY team_id, season_id HAVING avg(CAST(pts AS double)) > 25.5"""
)
def having_filter(v: Views) -> DataFrame:
    average = F.avg(F.col("pts").cast("double"))
    grouped = stats.grouped_having(
        v["player_game_log"],
        ["team_id", "season_id"],
        [F.count("*").alias("games"), average.alias("avg_pts")],
        F.col("avg_pts") > 25.5,
    )
    return grouped.withColumn("avg_pts", number("avg_pts"))


@query(
    with_views("player", PGTT)
    + f"""SELECT player_id, player_name, college FROM player
WHERE player_id IN (SELECT player_id FROM {PGTT} WHERE pts > 200)"""
)
def in_subquery(v: Views) -> DataFrame:
    high = v[PGTT].filter(F.col("pts") > 200)
    players = v["player"].select("player_id", "player_name", "college")
    return stats.where_in(players, "player_id", high, "player_id")


@query(
    with_views(PGTT)
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS extreme, player_id, season_id, {number_sql("pts")} FROM {PGTT}
WHERE pts = (SELECT {f}(pts) FROM {PGTT})"""
        for f in ("max", "min")
    )
)
def scalar_min_max_subquery(v: Views) -> DataFrame:
    def extreme(func: str) -> DataFrame:
        rows = stats.where_equals_extreme(v[PGTT], "pts", func)
        return rows.select(F.lit(func).alias("extreme"), "player_id", "season_id", number("pts"))

    return extreme("max").unionByName(extreme("min"))


@query(
    with_views("player_game_log")
    + """SELECT team_id, round(avg(CAST(pts AS double)), 4) AS avg_pts,
  round(sum(CAST(pts AS double)), 4) AS sum_pts, CAST(count(pts) AS bigint) AS count_pts,
  round(CAST(max(pts) AS double), 4) AS max_pts, round(CAST(min(pts) AS double), 4) AS min_pts
FROM player_game_log GROUP BY team_id"""
)
def agg_suite(v: Views) -> DataFrame:
    suite = stats.agg_suite(v["player_game_log"], ["team_id"], "pts")
    return suite.select(
        "team_id", "count_pts", *map(number, ["avg_pts", "sum_pts", "max_pts", "min_pts"])
    )


@query(
    with_views("player")
    + """SELECT CAST(count(*) FILTER (WHERE draft_round IS NULL) AS bigint) AS is_null,
  CAST(count(*) FILTER (WHERE draft_round IS NOT NULL) AS bigint) AS is_not_null FROM player"""
)
def null_predicates(v: Views) -> DataFrame:
    return stats.null_split(v["player"], "draft_round")


@query(
    with_views("player_season")
    + f"""SELECT player_id, season_id, {number_sql("pts")} FROM player_season
WHERE season_id = 20000 + 1999 - 1"""
)
def year_filter(v: Views) -> DataFrame:
    season = stats.in_end_year(v["player_season"], 1999)
    return season.select("player_id", "season_id", number("pts"))


# The other five ids of an event, as the feed has them: missing in most events.
_MORE_IDS = {
    "player1_team_id": "CASE WHEN player1_id % 2 = 0 THEN player1_id % 25 END",
    "player2_id": "CASE WHEN event_num % 3 = 0 THEN player1_id + 1 END",
    "player2_team_id": "CASE WHEN event_num % 3 = 0 THEN event_num % 30 END",
    "player3_id": "CASE WHEN event_num % 7 = 0 THEN player1_id + 2 END",
    "player3_team_id": "CASE WHEN event_num % 7 = 0 THEN event_num % 25 END",
}


@query(
    with_views(
        "event_message_type",
        "play_by_play",
        "player",
        "team",
        full_log="SELECT *, "
        + ", ".join(f"CAST({sql} AS int) AS {name}" for name, sql in _MORE_IDS.items())
        + " FROM play_by_play",
    )
    + """SELECT e.event_num, e.game_id, e.period, m.string AS event_type, e.player1_id,
  e.player2_id, e.player3_id, a.player_name AS player1_name, b.player_name AS player2_name,
  c.player_name AS player3_name, x.nickname AS team1, y.nickname AS team2, z.nickname AS team3
FROM full_log e LEFT JOIN event_message_type m ON e.event_msg_type_id = m.id
LEFT JOIN player a ON e.player1_id = a.player_id LEFT JOIN player b ON e.player2_id = b.player_id
LEFT JOIN player c ON e.player3_id = c.player_id LEFT JOIN team x ON e.player1_team_id = x.team_id
LEFT JOIN team y ON e.player2_team_id = y.team_id LEFT JOIN team z ON e.player3_team_id = z.team_id"""
)
def decode_events(v: Views) -> DataFrame:
    """Events with the names of all three players and teams; most ids are missing."""
    ids = {name: F.expr(sql).cast("int") for name, sql in _MORE_IDS.items()}
    tables = {name: v[name] for name in ("player", "team", "event_message_type")}
    decoded = stats.decode_events(tables | {"play_by_play": v["play_by_play"].withColumns(ids)})
    return decoded.select(
        "event_num", "game_id", "period", "event_type", "player1_id", "player2_id", "player3_id",
        "player1_name", "player2_name", "player3_name", "team1", "team2", "team3",
    )


_CAREER = {
    "career_w_pct": ("w", "gp"),
    "career_fg_pct": ("fgm", "fga"),
    "career_fg3_pct": ("fg3m", "fg3a"),
    "career_ppg": ("pts", "gp"),
    "career_rpg": ("reb", "gp"),
    "career_apg": ("ast", "gp"),
    "career_spg": ("stl", "gp"),
    "career_bpg": ("blk", "gp"),
    "career_topg": ("tov", "gp"),
}
_CAREER_SUMS = ["gp", "w", "l", *LOG_STATS]


def _sum(column: str) -> str:
    return f"sum(CAST({column} AS double))"


@query(
    with_views(PGTT)
    + f"""SELECT player_id, CAST(count(DISTINCT season_id) AS int) AS seasons_played,
  min(season_id) AS first_season, max(season_id) AS last_season,
  {", ".join(f"round({_sum(c)}, 4) AS total_{c}" for c in _CAREER_SUMS)},
  {", ".join(
      f"round({_sum(a)} / nullif({_sum(b)}, 0), 4) AS {n}" for n, (a, b) in _CAREER.items()
  )}
FROM {PGTT} GROUP BY player_id"""
)
def career_totals(v: Views) -> DataFrame:
    career = aggregates.career_totals(v[PGTT])
    exact = ["player_id", "seasons_played", "first_season", "last_season"]
    return career.select(*exact, *[number(c) for c in career.columns if c not in exact])


_RANKED = ["gp", "pts", "reb", "ast", "tov", "blk", "stl", "fg3_pct"]


@query(
    with_views(PGTT)
    + "SELECT player_id, season_id, "
    + ", ".join(
        f"""CAST(rank() OVER (PARTITION BY season_id ORDER BY {c} DESC NULLS FIRST) AS int)
    AS {c}_rank"""
        for c in _RANKED
    )
    + f" FROM {PGTT}"
)
def season_ranks(v: Views) -> DataFrame:
    totals = v[PGTT].select("player_id", "season_id", *_RANKED)
    return aggregates.season_ranks(stored(totals, "totals"), _RANKED)


_FROM_LOG = ["gp", "w", "l", *LOG_STATS]


@query(
    with_views("player_game_log")
    + f"""SELECT player_id, season_id, round(CAST(count(*) AS double), 4) AS gp,
  round(CAST(count(*) FILTER (WHERE wl = 'W') AS double), 4) AS w,
  round(CAST(count(*) FILTER (WHERE wl = 'L') AS double), 4) AS l,
  {", ".join(f"round({_sum(c)}, 4) AS {c}" for c in LOG_STATS)},
  round(CAST(count(*) FILTER (WHERE wl = 'W') AS double) / count(*), 4) AS w_pct,
  round({_sum("fgm")} / nullif({_sum("fga")}, 0), 4) AS fg_pct,
  round({_sum("fg3m")} / nullif({_sum("fg3a")}, 0), 4) AS fg3_pct
FROM player_game_log GROUP BY player_id, season_id"""
)
def season_totals_from_log(v: Views) -> DataFrame:
    totals = aggregates.season_totals(v["player_game_log"])
    return totals.select(
        "player_id", "season_id", *map(number, [*_FROM_LOG, "w_pct", "fg_pct", "fg3_pct"])
    )


@query(
    with_views(PGTT)
    + f"""SELECT player_id, season_id, team_id, gp,
  {", ".join(
      f"round(CAST({c} AS double) / nullif(gp, 0), 4) AS {c}" for c in ("pts", "reb", "ast")
  )}
FROM {PGTT}"""
)
def per_game_from_totals(v: Views) -> DataFrame:
    averages = aggregates.per_game(v[PGTT])
    keys = ["player_id", "season_id", "team_id", "gp"]
    return averages.select(*keys, *map(number, ["pts", "reb", "ast"]))


_TENS = " + ".join(f"CASE WHEN {c} >= 10 THEN 1 ELSE 0 END" for c in aggregates.DOUBLE_STATS)


@query(
    with_views("player_game_log")
    + f"""SELECT player_id, game_id, CAST({_TENS} >= 2 AS int) AS dd2,
  CAST({_TENS} >= 3 AS int) AS td3 FROM player_game_log"""
)
def double_double(v: Views) -> DataFrame:
    flagged = aggregates.double_double(v["player_game_log"])
    return flagged.select("player_id", "game_id", "dd2", "td3")


@query(
    with_views(PGTT)
    + f"""SELECT player_id, season_id,
  round(CAST(fgm AS double) / nullif(CAST(fga AS double), 0), 4) AS fg_pct,
  round(CAST(fg3m AS double) / nullif(CAST(fg3a AS double), 0), 4) AS fg3_pct FROM {PGTT}"""
)
def shooting_pcts(v: Views) -> DataFrame:
    rates = aggregates.shooting_pcts(v[PGTT])
    return rates.select("player_id", "season_id", number("fg_pct"), number("fg3_pct"))
