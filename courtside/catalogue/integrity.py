"""Keys, integrity checks and write semantics on induced faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.catalogue import number, query
from courtside.fixtures import ARRIVAL, PGTT, Views, with_views
from courtside.operators import integrity as checks
from courtside.operators import keys as k
from courtside.plans.warehouse import SeasonInputs, apply_season
from courtside.schemas import TABLES
from courtside.session import pin, scratch_path, stored
from courtside.sources.files import replace_all as store_all

KEY = ["player_id", "game_id"]
LOG = TABLES["player_game_log"]
_ORDER = ", ".join(ARRIVAL)
_REVERSE = ", ".join(f"{c} DESC" for c in ARRIVAL)

# A stored part (seasons up to 21998) and a later feed that overlaps it by two seasons.
_TARGET_SQL = "SELECT * FROM player_game_log WHERE season_id <= 21998"
_BATCH_SQL = f"""SELECT * REPLACE (CAST(pts + 1 AS float) AS pts) FROM raw_game_log
WHERE season_id >= 21997"""


def _target(v: Views) -> DataFrame:
    return v["player_game_log"].filter(F.col("season_id") <= 21998)


def _batch(v: Views) -> DataFrame:
    later = v["raw_game_log"].filter(F.col("season_id") >= 21997)
    return later.withColumn("pts", (F.col("pts") + 1).cast("float"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "team_id", "season_id", number("pts"), number("reb"))


_SHOWN_SQL = """player_id, game_id, team_id, season_id, round(CAST(pts AS double), 4) AS pts,
  round(CAST(reb AS double), 4) AS reb"""


@query(
    with_views(
        "player_game_log",
        target=_TARGET_SQL,
        batch=_BATCH_SQL,
        fresh=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, game_id
      ORDER BY {_ORDER}) AS rn FROM batch) x WHERE rn = 1
    AND NOT EXISTS (SELECT 1 FROM target t
      WHERE t.player_id = x.player_id AND t.game_id = x.game_id)""",
    )
    + f"SELECT {_SHOWN_SQL} FROM target UNION ALL SELECT {_SHOWN_SQL} FROM fresh"
)
def insert_ignore(v: Views) -> DataFrame:
    return _shown(k.insert_ignore(_target(v), _batch(v), KEY, ARRIVAL))


@query(
    with_views("raw_game_log")
    + f"""SELECT {_SHOWN_SQL}, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (
  PARTITION BY player_id, game_id ORDER BY {_ORDER}) AS rn FROM raw_game_log) x WHERE rn = 1"""
)
def dedupe_first(v: Views) -> DataFrame:
    first = k.dedupe_first(v["raw_game_log"], KEY, ARRIVAL)
    return first.select(
        *KEY, "team_id", "season_id", number("pts"), number("reb"), "l_linenumber", "l_suppkey"
    )


@query(
    with_views(
        "player_game_log",
        target=_TARGET_SQL,
        batch=_BATCH_SQL,
        newest=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, game_id
      ORDER BY {_REVERSE}) AS rn FROM batch) x WHERE rn = 1""",
    )
    + f"""SELECT {_SHOWN_SQL} FROM target t WHERE NOT EXISTS (SELECT 1 FROM newest n
  WHERE t.player_id = n.player_id AND t.game_id = n.game_id)
UNION ALL SELECT {_SHOWN_SQL} FROM newest"""
)
def upsert_replace(v: Views) -> DataFrame:
    return _shown(k.upsert(_target(v), _batch(v), KEY, ARRIVAL))


@query(
    with_views("raw_game_log")
    + """SELECT CAST(count(*) AS bigint) AS repeated_keys,
  CAST(coalesce(sum(n - 1), 0) AS bigint) AS rows_replaced
FROM (SELECT count(*) AS n FROM raw_game_log GROUP BY player_id, game_id HAVING count(*) > 1) x"""
)
def upsert_conflicts(v: Views) -> DataFrame:
    return k.batch_conflicts(v["raw_game_log"], KEY)


# Faults: parents without the undrafted players and without New Year's games, a NULL
# team (which must pass), and logs that name no player.
_PARENTS = {
    "known_players": "SELECT * FROM player WHERE draft_year <> 'Undrafted'",
    "known_games": "SELECT * FROM game WHERE NOT (month(date) = 1 AND day(date) = 1)",
    "faulty": "SELECT * REPLACE (nullif(team_id, 5) AS team_id) FROM raw_game_log",
    "marked": """SELECT *,
    CASE WHEN player_id NOT IN (SELECT player_id FROM known_players)
      THEN 'player_id: no such player' END AS r1,
    CASE WHEN game_id NOT IN (SELECT game_id FROM known_games)
      THEN 'game_id: no such game' END AS r2 FROM faulty""",
}


def _parents(v: Views) -> dict[str, DataFrame]:
    date = F.col("date")
    return {
        "player": v["player"].filter(F.col("draft_year") != "Undrafted"),
        "game": v["game"].filter(~((F.month(date) == 1) & (F.dayofmonth(date) == 1))),
        "team": v["team"],
    }


def _faulty(v: Views) -> DataFrame:
    # Stored like a landed feed: the checks read it more than once.
    return pin(v["raw_game_log"].withColumn("team_id", F.nullif(F.col("team_id"), F.lit(5))))


def _with_reasons(df: DataFrame) -> DataFrame:
    reasons = F.array_join("_reasons", "; ").alias("reasons")
    return df.select(*KEY, "team_id", *ARRIVAL[:3], reasons)


@query(
    with_views(
        "raw_game_log",
        "player",
        "game",
        **_PARENTS,
        numbered=f"""SELECT *, CASE WHEN r1 IS NULL AND r2 IS NULL THEN row_number() OVER (
      PARTITION BY player_id, game_id, r1, r2 ORDER BY {_ORDER}) END AS rn FROM marked""",
    )
    + """SELECT player_id, game_id, team_id, l_linenumber, l_suppkey, l_extendedprice,
  concat_ws('; ', r1, r2, CASE WHEN rn > 1 THEN 'player_id, game_id: duplicate key' END)
    AS reasons FROM numbered"""
)
def fk_row_reject(v: Views) -> DataFrame:
    good, rejects = checks.split_valid(_faulty(v), LOG, _parents(v), ARRIVAL)
    none = good.withColumn("_reasons", F.array().cast("array<string>"))
    return _with_reasons(none.unionByName(rejects))


@query(
    with_views(
        "raw_game_log",
        "player",
        "game",
        **_PARENTS,
        bad="SELECT DISTINCT game_id FROM marked WHERE r1 IS NOT NULL OR r2 IS NOT NULL",
    )
    + """SELECT player_id, game_id, team_id, l_linenumber, l_suppkey, l_extendedprice,
  CASE WHEN game_id IN (SELECT game_id FROM bad) THEN 'rejected: ' || concat_ws('; ', r1, r2)
    ELSE 'loaded' END AS reasons FROM marked"""
)
def fk_batch_reject(v: Views) -> DataFrame:
    good, rejects = checks.split_valid_batches(_faulty(v), "game_id", LOG, _parents(v))
    columns = [*KEY, "team_id", *ARRIVAL[:3]]
    why = F.concat(F.lit("rejected: "), F.array_join("_reasons", "; "))
    loaded = good.select(*columns, F.lit("loaded").alias("reasons"))
    return loaded.unionByName(rejects.select(*columns, why.alias("reasons")))


@query(
    with_views(
        "raw_game_log",
        holed="SELECT * REPLACE (nullif(player_id, 7) AS player_id) FROM raw_game_log",
    )
    + f"""SELECT player_id, game_id, l_linenumber, l_suppkey, l_extendedprice,
  CASE WHEN player_id IS NULL THEN 'player_id: null key'
    WHEN row_number() OVER (PARTITION BY player_id, game_id ORDER BY {_ORDER}) > 1
    THEN 'player_id, game_id: duplicate key' ELSE '' END AS reasons FROM holed"""
)
def not_null_pk_reject(v: Views) -> DataFrame:
    holed = v["raw_game_log"].withColumn("player_id", F.nullif(F.col("player_id"), F.lit(7)))
    flagged = checks.flag_rows(pin(holed), LOG, {}, ARRIVAL)
    return _with_reasons(flagged).drop("team_id")


@query(
    with_views("raw_game_log", "player", "game", **_PARENTS)
    + """SELECT 'player' AS table_name,
  CAST(count(*) FILTER (WHERE draft_number IS NULL OR draft_number NOT IN ('49', '50')) AS bigint)
    AS inserted, CAST(count(*) AS bigint) AS total,
  CAST(count(*) FILTER (WHERE draft_number IN ('49', '50')) AS bigint) AS errors FROM player
UNION ALL SELECT 'player_game_log',
  CAST(count(*) FILTER (WHERE r1 IS NULL AND r2 IS NULL) AS bigint), CAST(count(*) AS bigint),
  CAST(count(*) FILTER (WHERE r1 IS NOT NULL OR r2 IS NOT NULL) AS bigint) FROM marked"""
)
def load_report(v: Views) -> DataFrame:
    too_long = F.when(F.col("draft_number").isin("49", "50"), F.repeat(F.lit("x"), 300))
    players = v["player"].withColumn("country", F.coalesce(too_long, F.col("country")))
    flagged = {
        "player": checks.flag_rows(players, TABLES["player"], {}),
        "player_game_log": checks.flag_rows(_faulty(v), LOG, _parents(v)),
    }
    return checks.load_report(flagged)


@query(
    with_views("raw_game_log", "player", "game", **_PARENTS)
    + """SELECT 'player_game_log' AS table_name,
  CAST(row_number() OVER (ORDER BY player_id, game_id, l_linenumber, l_suppkey) AS int)
    AS error_number, concat_ws('; ', r1, r2) AS reasons
FROM marked WHERE r1 IS NOT NULL OR r2 IS NOT NULL
ORDER BY player_id, game_id, l_linenumber, l_suppkey LIMIT 3"""
)
def reject_samples(v: Views) -> DataFrame:
    flagged = checks.flag_rows(_faulty(v), LOG, _parents(v))
    order = [*KEY, "l_linenumber", "l_suppkey"]
    samples = checks.reject_samples({"player_game_log": flagged}, order)
    return samples.select("table_name", "error_number", "reasons")


_HASH = "md5(concat_ws('|', '', CAST(player_id AS varchar), CAST(season_id AS varchar)))"


@query(
    with_views("player_season")
    + f"""SELECT player_id, season_id, CAST(row_number() OVER (
  ORDER BY {_HASH}, player_id, season_id) AS bigint) AS id FROM player_season"""
)
def surrogate_id(v: Views) -> DataFrame:
    keys = ["player_id", "season_id"]
    return k.with_surrogate_id(v["player_season"].select(*keys), keys)


# One season (1998-99) applied to a store that holds it in part, with other points, and
# the seasons before it.
_LOG_ROWS = """SELECT player_id, game_id, season_id, CAST(pts AS double) AS pts FROM {}"""


def _season_feed(v: Views, table: str, **changed: Column) -> DataFrame:
    """Rows of season 21998 under the feed's column names, with an arrival order."""
    rows = v[table]
    if "season_id" in rows.columns:
        rows = rows.filter(F.col("season_id") == 21998)
    rows = rows.withColumns(changed) if changed else rows
    renamed = {
        "game_id": "GAME_ID" if table != "raw_game_log" else "Game_ID",
        "team_id_home_id": "TEAM_ID",
        "date": "GAME_DATE",
        "event_num": "EVENTNUM",
        "event_msg_type_id": "EVENTMSGTYPE",
    }
    return rows.select(
        *[F.col(c).alias(renamed.get(c, c.upper())) for c in rows.columns if c not in ARRIVAL],
        # These hold one row per key, so any order is theirs.
        *[F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in ARRIVAL],
    )


def _typed(df: DataFrame, table: str) -> DataFrame:
    """A fixture view widened to the declared columns."""
    spec = TABLES[table]
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(spec.schema[c].dataType).alias(c)
            for c in spec.loaded_columns
        ]
    )


@query(
    with_views(
        "player",
        "game",
        "player_game_log",
        "player_season",
        PGTT,
        "play_by_play",
        before="SELECT * FROM player_game_log WHERE season_id <= 21998 AND pts > 10",
        after=f"""{_LOG_ROWS.format("before")} UNION ALL
      {_LOG_ROWS.format("player_game_log")} p WHERE season_id = 21998 AND NOT EXISTS (
        SELECT 1 FROM before b WHERE b.player_id = p.player_id AND b.game_id = p.game_id)""",
        events="""SELECT event_num, period FROM play_by_play
      WHERE game_id IN (SELECT game_id FROM game WHERE season_id = 21998)""",
    )
    + f"""SELECT 'player' AS table_name, CAST(NULL AS int) AS season_id, CAST(count(*) AS bigint) AS n,
  CAST(count(*) FILTER (WHERE draft_round IS NULL) AS double) AS total FROM player
UNION ALL SELECT 'game', season_id, CAST(count(*) AS bigint), 0 FROM game
  WHERE season_id <= 21998 GROUP BY season_id
UNION ALL SELECT 'player_game_log', season_id, CAST(count(*) AS bigint), round(sum(pts), 2)
  FROM after GROUP BY season_id
UNION ALL SELECT 'player_season', season_id, CAST(count(*) AS bigint), round(sum(round(CAST(
  CASE WHEN season_id < 21998 THEN pts + 1 WHEN player_id % 3 = 0 THEN pts + 5 ELSE pts END
  AS double), 4)), 2) FROM player_season WHERE season_id <= 21998 GROUP BY season_id
UNION ALL SELECT '{PGTT}', season_id, CAST(count(*) AS bigint), round(sum(CAST(
  CASE WHEN season_id < 21998 THEN pts + 1 ELSE pts END AS double)), 2)
  FROM {PGTT} WHERE season_id <= 21998 GROUP BY season_id
UNION ALL SELECT 'play_by_play', NULL, CAST(count(*) AS bigint), CAST(sum(event_num) AS double)
  FROM (SELECT event_num FROM events UNION ALL SELECT event_num FROM events WHERE period = 1) e"""
)
def season_increment(v: Views) -> DataFrame:
    """All six tables of a season: rows and a total per season after it was applied.

    Players and games already stored keep their rows, every third player's statistics come
    twice (the later row counts), logs stored before win, and events of the first period
    that were stored before are there twice.
    """
    # Every check and merge reads its tables again, so they are made once.
    v = v.stored(scratch_path(v.spark, "increment"))
    known = v["player"].filter(F.col("draft_round").isNotNull())
    stored_log = v["player_game_log"].filter((F.col("season_id") <= 21998) & (F.col("pts") > 10))
    plus_one = {"pts": F.col("pts") + 1}

    def older(name: str) -> DataFrame:
        return v[name].filter(F.col("season_id") <= 21998)

    games = v["game"].filter(F.col("season_id") == 21998).select("game_id")
    events = v["play_by_play"].drop("player1_id").join(games, "game_id", "left_semi")
    state = {
        "event_message_type": v["event_message_type"],
        "player": _typed(known, "player"),
        "game": _typed(v["game"].filter(F.col("season_id") < 21998), "game"),
        "team": v["team"],
        "player_game_log": _typed(stored_log, "player_game_log"),
        "player_season": _typed(older("player_season").withColumns(plus_one), "player_season"),
        PGTT: _typed(older(PGTT).withColumns(plus_one), PGTT),
        "play_by_play": _typed(events.filter("period = 1"), "play_by_play"),
    }
    late = _season_feed(v, "player_season", pts=F.col("pts") + 5).filter("PLAYER_ID % 3 = 0")
    inputs = SeasonInputs(
        "1998-99",
        ARRIVAL,
        players=_season_feed(v, "player", player_name=F.concat("player_name", F.lit("!"))),
        games=_season_feed(v, "game"),
        player_season=_season_feed(v, "player_season").unionByName(
            late.withColumn(ARRIVAL[0], F.lit(1))
        ),
        totals=_season_feed(v, PGTT),
        game_log=stored(_season_feed(v, "raw_game_log"), "feed-log"),
        play_by_play=_season_feed(v, "play_by_play").drop("PLAYER1_ID"),
    )
    after, _ = apply_season(state, inputs)

    def totals(name: str, total: Column, season: Column | None = None) -> DataFrame:
        by = F.lit(None).cast("int") if season is None else season
        grouped = after[name].groupBy(by.alias("season_id"))
        return grouped.agg(
            F.count("*").alias("n"), F.round(total.cast("double"), 2).alias("total")
        ).select(F.lit(name).alias("table_name"), "season_id", "n", "total")

    points, season = F.col("pts").cast("double"), F.col("season_id")
    return reduce(
        DataFrame.unionByName,
        [
            totals("player", F.count_if(F.col("player_name").endswith("!"))),
            totals("game", F.lit(0), season),
            totals("player_game_log", F.sum(points), season),
            totals("player_season", F.sum(F.round(points, 4)), season),
            totals(PGTT, F.sum(points), season),
            totals("play_by_play", F.sum("event_num")),
        ],
    )


@query(
    with_views("game")
    + """SELECT season_id, CAST(count(*) AS bigint) AS n, CAST(count(DISTINCT game_id) AS bigint)
  AS games FROM game GROUP BY season_id"""
)
def replace_all(v: Views) -> DataFrame:
    """Stored twice: the second write leaves no row of the first."""
    path = scratch_path(v.spark, "replace-all")
    store_all(v["game"], path, "season_id")
    store_all(v["game"], path, "season_id")
    stored = v.spark.read.schema(v["game"].schema).parquet(path)
    return stored.groupBy("season_id").agg(
        F.count("*").alias("n"), F.count_distinct("game_id").alias("games")
    )
