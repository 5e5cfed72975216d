"""Sources, feed normalisers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.catalogue import number, query
from courtside.catalogue.evaluation import OUTCOMES, SUMMARY_LINES_SQL, outcomes
from courtside.catalogue.text import difficulty_text, type_text, words_text
from courtside.fixtures import ARRIVAL, PGTT, Views, with_views
from courtside.operators.aggregates import season_ranks
from courtside.operators.corpus import label_corpus
from courtside.operators.report import summary_lines
from courtside.plans.warehouse import load_all
from courtside.schemas import TABLES, catalog_df, catalog_rows
from courtside.session import scratch_path, stored
from courtside.sources import feeds, files

_ORDER = ", ".join(ARRIVAL)
_SEASON = 21998


# -- the declared catalogue, measured against the stored tables ---------------------
_PROFILED = [
    "event_message_type", "team", "player", "game", "player_game_log", PGTT, "player_season",
    "play_by_play",
]


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return str(value) if isinstance(value, int) else f"'{value}'"


def _profile_sql() -> str:
    columns = {name: _VIEW_COLUMNS[name] for name in _PROFILED}
    counts = " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, '{c}' AS column_name,
  CAST(count({c}) AS bigint) AS n_values FROM {name}"""
        for name, present in columns.items()
        for c in present
    )
    values = ", ".join(
        "(" + ", ".join(_literal(x) for x in row) + ")" for row in catalog_rows()
    )
    return (
        with_views(*_PROFILED, counts=counts)
        + f"""SELECT c.*, coalesce(n.n_values, 0) AS n_values
FROM (SELECT * FROM (VALUES {values}) AS t(table_name, position, column_name, data_type,
    in_primary_key, in_unique, parent, max_length)) c
LEFT JOIN counts n USING (table_name, column_name)"""
    )


_VIEW_COLUMNS = {
    "event_message_type": TABLES["event_message_type"].columns,
    "team": TABLES["team"].columns,
    "player": TABLES["player"].columns,
    "game": TABLES["game"].columns,
    "player_game_log": (
        "player_id game_id team_id season_id wl pts reb ast tov blk stl pf fgm fga fg3m fg3a"
    ).split(),
    PGTT: (
        "player_id season_id team_id gp w l pts reb ast tov blk stl pf fgm fga fg3m fg3a fg3_pct"
    ).split(),
    "player_season": "player_id season_id team_id gp pts reb ast".split(),
    "play_by_play": "game_id event_num event_msg_type_id period player1_id".split(),
}


@query(_profile_sql())
def schema_catalog(v: Views) -> DataFrame:
    """Every declared column with the number of values the stored tables have in it."""
    counts = None
    tables = v.stored(scratch_path(v.spark, "profiled"), ["player_game_log", PGTT])
    for name in _PROFILED:
        columns = _VIEW_COLUMNS[name]
        one = tables[name].agg(*[F.count(c).alias(c) for c in columns])
        long = one.unpivot([], columns, "column_name", "n_values")
        long = long.select(F.lit(name).alias("table_name"), "column_name", "n_values")
        counts = long if counts is None else counts.unionByName(long)
    declared = catalog_df(v.spark).withColumns(
        {c: F.col(c).cast("int") for c in ("in_primary_key", "in_unique")}
    )
    return declared.join(counts, ["table_name", "column_name"], "left").withColumn(
        "n_values", F.coalesce("n_values", F.lit(0))
    )


# -- CSV --------------------------------------------------------------------------
@query(
    with_views("game")
    + """SELECT game_id, team_id_home_id, team_id_away_id, season_id,
  CAST(date AS varchar) AS date, '' AS reasons FROM game"""
)
def csv_scan(v: Views) -> DataFrame:
    """Games through a CSV file with upper-case headers; leading zeros survive."""
    path = scratch_path(v.spark, "game-csv")
    upper = v["game"].select(*[F.col(c).alias(c.upper()) for c in v["game"].columns])
    files.write_csv(upper, path)
    rows = files.read_table_csv(v.spark, path, TABLES["game"])
    return rows.select(
        "game_id",
        "team_id_home_id",
        "team_id_away_id",
        "season_id",
        F.col("date").cast("string").alias("date"),
        F.array_join("_reasons", "; ").alias("reasons"),
    )


@query(
    with_views("player")
    + """SELECT 'ignore' AS mode, player_id, player_name, college, CAST(NULL AS varchar) AS country,
  draft_number, '' AS reasons FROM player
UNION ALL SELECT 'reject', player_id, player_name, college, NULL, draft_number,
  'unknown column: nickname' FROM player"""
)
def align_columns(v: Views) -> DataFrame:
    """A source without a country and with a nickname, under both rules."""
    source = v["player"].select(
        F.col("player_id").cast("string").alias("PLAYER_ID"),
        F.col("player_name").alias("FULL_NAME"),
        F.col("college").alias("COLLEGE"),
        F.col("draft_number").alias("DRAFT_NUMBER"),
        F.col("player_name").alias("NICKNAME"),
    )
    columns = ["player_id", "player_name", "college", "country", "draft_number"]

    def run(mode: str) -> DataFrame:
        rows = feeds.align(source, TABLES["player"], {"player_name": "FULL_NAME"}, mode)
        reasons = F.array_join("_reasons", "; ") if mode == "reject" else F.lit("")
        return rows.select(F.lit(mode).alias("mode"), *columns, reasons.alias("reasons"))

    return run("ignore").unionByName(run("reject"))


@query(
    with_views(
        "team",
        "player",
        "game",
        "player_game_log",
        players="""SELECT *, coalesce(draft_number IN ('49', '50'), false) AS bad FROM player""",
        logs="""SELECT g.*, p.bad FROM player_game_log g JOIN players p USING (player_id)""",
    )
    + """SELECT 'team' AS table_name, CAST(count(*) AS bigint) AS inserted,
  CAST(count(*) AS bigint) AS total, CAST(0 AS bigint) AS errors FROM team
UNION ALL SELECT 'player', count(*) FILTER (WHERE NOT bad), count(*),
  count(*) FILTER (WHERE bad) FROM players
UNION ALL SELECT 'game', count(*), count(*), 0 FROM game
UNION ALL SELECT 'player_game_log', count(*) FILTER (WHERE NOT bad), count(*),
  count(*) FILTER (WHERE bad) FROM logs"""
)
def load_order(v: Views) -> DataFrame:
    """A folder of CSVs, parents first; players with overlong text take their logs along.

    The files are compressed, one a task: as text they take three times the space of the tables.
    """
    folder = scratch_path(v.spark, "csv-in")
    too_long = F.when(F.col("draft_number").isin("49", "50"), F.repeat(F.lit("x"), 300))
    tables = {
        "team": v["team"],
        "player": v["player"].withColumn("country", F.coalesce(too_long, F.col("country"))),
        "game": v["game"],
        "player_game_log": v["player_game_log"],
    }
    for name, df in tables.items():
        files.write_csv(df, f"{folder}/{name}.csv", compression="gzip")
    return load_all(v.spark, folder, scratch_path(v.spark, "warehouse")).report


# -- dimensions and feeds -----------------------------------------------------------
@query(
    with_views("event_message_type", "play_by_play")
    + """SELECT m.id, m.string, CAST(count(e.event_num) AS bigint) AS n_events
FROM event_message_type m LEFT JOIN play_by_play e ON e.event_msg_type_id = m.id
GROUP BY m.id, m.string"""
)
def dim_event_type(v: Views) -> DataFrame:
    """The event types with the number of events of each."""
    counts = v["play_by_play"].groupBy("event_msg_type_id").agg(F.count("*").alias("n_events"))
    return (
        v["event_message_type"]
        .join(counts, F.col("id") == F.col("event_msg_type_id"), "left")
        .select("id", "string", F.coalesce("n_events", F.lit(0)).alias("n_events"))
    )


@query(
    """SELECT CAST(s_suppkey AS int) AS team_id, concat('S', s_suppkey) AS abbreviation,
  s_name AS nickname, CASE WHEN s_nationkey < 5 THEN '' ELSE CAST(1946 + s_nationkey AS varchar)
  END AS year_founded, CAST(NULL AS varchar) AS city FROM supplier"""
)
def dim_team(v: Views) -> DataFrame:
    """Teams from a static list; a missing founding year becomes empty text."""
    founded = F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey") + 1946)
    listed = v.base("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("S"), "s_suppkey").alias("abbreviation"),
        F.col("s_name").alias("nickname"),
        founded.alias("year_founded"),
    )
    return feeds.normalise_team(listed)


_FIRST = "row_number() OVER (PARTITION BY {} ORDER BY {})"
_LINE_ORDER = ["l_orderkey", *ARRIVAL]


@query(
    "WITH ranked AS (SELECT p.*, l.l_linenumber, "
    + _FIRST.format("l_partkey", ", ".join(_LINE_ORDER))
    + """ AS rn FROM lineitem l JOIN part p ON l_partkey = p_partkey)
SELECT CAST(p_partkey AS int) AS player_id, concat(p_name, ' ', l_linenumber) AS player_name,
  p_brand AS college, p_type AS country, nullif(CAST(1970 + p_size AS varchar), '') AS draft_year,
  CASE WHEN p_size >= 5 THEN CAST(1 + p_size % 2 AS varchar) END AS draft_round,
  CAST(NULL AS varchar) AS draft_number FROM ranked WHERE rn = 1"""
)
def norm_player(v: Views) -> DataFrame:
    """A feed that repeats players: the first row of each is kept."""
    lines = v.base("lineitem").select("l_partkey", *_LINE_ORDER)
    size = F.col("p_size")
    raw = lines.join(v.base("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").cast("string").alias("PLAYER_ID"),
        F.concat_ws(" ", "p_name", "l_linenumber").alias("PLAYER_NAME"),
        F.col("p_brand").alias("COLLEGE"),
        F.col("p_type").alias("COUNTRY"),
        (size + 1970).alias("DRAFT_YEAR"),
        F.when(size >= 5, (size % 2 + 1).cast("string")).otherwise("").alias("DRAFT_ROUND"),
        *_LINE_ORDER,
    )
    return feeds.normalise_player(raw, _LINE_ORDER)


@query(
    with_views("raw_game_log")
    + f"""SELECT game_id, team_id AS team_id_home_id, CAST(NULL AS int) AS team_id_away_id,
  season_id, CAST(CAST(o_orderdate AS date) AS varchar) AS date
FROM (SELECT *, {_FIRST.format("game_id", f"player_id, {_ORDER}")} AS rn FROM raw_game_log) r
JOIN orders ON CAST(game_id AS bigint) = o_orderkey WHERE rn = 1"""
)
def norm_game(v: Views) -> DataFrame:
    """One row per game from a log with a row per team and player."""
    dates = v.base("orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("GAME_ID"),
        F.to_date("o_orderdate").cast("string").alias("GAME_DATE"),
    )
    log = v["raw_game_log"].select(
        F.col("game_id").alias("GAME_ID"),
        F.col("team_id").cast("string").alias("TEAM_ID"),
        F.col("season_id").cast("string").alias("SEASON_ID"),
        "player_id",
        *ARRIVAL,
    )
    games = feeds.normalise_game(log.join(dates, "GAME_ID"), ["player_id", *ARRIVAL])
    return games.withColumn("date", F.col("date").cast("string"))


@query(
    with_views("raw_game_log", "player")
    + """SELECT player_id, game_id, team_id, season_id, wl, round(CAST(pts AS double), 4) AS pts,
  round(CAST(reb AS double), 4) AS reb, CASE WHEN tov <> 3 THEN round(CAST(tov AS double), 4) END
  AS tov, CAST(NULL AS double) AS ftm
FROM raw_game_log WHERE player_id IN (SELECT player_id FROM player WHERE draft_round IS NOT NULL)"""
)
def norm_game_log(v: Views) -> DataFrame:
    """Text-valued logs, some unreadable, of players that are loaded."""
    raw = v["raw_game_log"].select(
        F.col("player_id").cast("string").alias("PLAYER_ID"),
        F.col("game_id").alias("Game_ID"),
        F.col("team_id").cast("string").alias("TEAM_ID"),
        F.col("season_id").cast("string").alias("SEASON_ID"),
        F.col("wl").alias("WL"),
        F.col("pts").cast("string").alias("PTS"),
        F.col("reb").alias("REB"),
        F.when(F.col("tov") == 3, "n.a.").otherwise(F.col("tov").cast("string")).alias("TOV"),
    )
    players = v["player"].filter(F.col("draft_round").isNotNull())
    rows = feeds.normalise_game_log(raw, players)
    return rows.select(
        "player_id", "game_id", "team_id", "season_id", "wl",
        number("pts"), number("reb"), number("tov"), number("ftm"),
    )


@query(
    with_views("play_by_play", "game")
    + """SELECT game_id, CAST(event_num AS int) AS event_num, event_msg_type_id, period,
  concat('play ', event_num) AS home_description, player1_id, CAST(NULL AS int) AS player2_id
FROM play_by_play WHERE game_id IN (SELECT game_id FROM game WHERE season_id = 21998)"""
)
def norm_play_by_play(v: Views) -> DataFrame:
    """Events of one season's games; repeats stay."""
    raw = v["play_by_play"].select(
        F.col("game_id").alias("GAME_ID"),
        F.col("event_num").cast("string").alias("EVENTNUM"),
        F.col("event_msg_type_id").alias("EVENTMSGTYPE"),
        F.col("period").cast("string").alias("PERIOD"),
        F.concat(F.lit("play "), "event_num").alias("HOMEDESCRIPTION"),
        F.col("player1_id").alias("PLAYER1_ID"),
    )
    rows = feeds.normalise_pbp(raw, v["game"].filter(F.col("season_id") == _SEASON))
    return rows.select(
        "game_id", "event_num", "event_msg_type_id", "period", "home_description",
        "player1_id", "player2_id",
    )


@query(
    with_views("player_season")
    + """SELECT player_id, season_id, team_id, CAST(20 + player_id % 20 AS int) AS age,
  concat(5 + player_id % 3, '-', player_id % 12) AS player_height,
  CAST(12 * (5 + player_id % 3) + player_id % 12 AS int) AS player_height_inches,
  round(CAST(gp AS double), 4) AS gp, round(CAST(pts AS double), 4) AS pts,
  CAST(NULL AS double) AS net_rating FROM player_season WHERE season_id = 21998"""
)
def norm_player_season(v: Views) -> DataFrame:
    season = v["player_season"].filter(F.col("season_id") == _SEASON)
    player = F.col("player_id")
    raw = season.select(
        player.cast("string").alias("PLAYER_ID"),
        F.col("team_id").alias("TEAM_ID"),
        (player % 20 + 20).cast("double").alias("PLAYER_AGE"),
        F.concat_ws("-", player % 3 + 5, player % 12).alias("PLAYER_HEIGHT"),
        F.col("gp").alias("GP"),
        F.col("pts").cast("string").alias("PTS"),
    )
    rows = feeds.normalise_player_season(raw, "1998-99")
    return rows.select(
        "player_id", "season_id", "team_id", "age", "player_height", "player_height_inches",
        number("gp"), number("pts"), number("net_rating"),
    )


@query(
    with_views(PGTT)
    + f"""SELECT player_id, season_id, team_id, gp, w, l, round(CAST(pts AS double), 4) AS pts,
  round(CAST(fg3m AS double), 4) AS fg3m, round(CAST(fg3m AS double), 4) AS fg3lm,
  CAST(rank() OVER (ORDER BY pts DESC) AS int) AS pts_rank, CAST(NULL AS int) AS cfid
FROM {PGTT} WHERE season_id = 21998"""
)
def norm_season_totals(v: Views) -> DataFrame:
    columns = ["player_id", "team_id", "gp", "w", "l", "pts", "fg3m", "pts_rank"]
    totals = v[PGTT].filter(F.col("season_id") == _SEASON).select("season_id", *columns[:-1])
    season = stored(totals, "season-totals")
    ranked = season.join(season_ranks(season, ["pts"]), ["player_id", "season_id"])
    raw = ranked.select(*[F.col(c).cast("string").alias(c.upper()) for c in columns])
    rows = feeds.normalise_totals(raw, "1998-99")
    return rows.select(
        "player_id", "season_id", "team_id", "gp", "w", "l",
        number("pts"), number("fg3m"), number("fg3lm"), "pts_rank", "cfid",
    )


# -- the corpus and the reports -----------------------------------------------------
@query(
    with_views("sql_pairs")
    + """SELECT CAST(example_id AS varchar) AS example_id,
  concat('  ', question, chr(10), 'said "x", twice ', chr(10)) AS input, gold_sql AS output
FROM sql_pairs"""
)
def corpus_scan(v: Views) -> DataFrame:
    """Questions with outer blanks, line breaks, quotes and commas through a CSV file."""
    path = scratch_path(v.spark, "corpus")
    asked = F.concat(F.lit("  "), "question", F.lit('\nsaid "x", twice \n'))
    corpus = v["sql_pairs"].select(
        "example_id", asked.alias("input"), F.col("gold_sql").alias("output")
    )
    files.write_csv(corpus, path)
    return files.read_corpus(v.spark, path).select("example_id", "input", "output")


@query(
    with_views("sql_pairs")
    + f"""SELECT question AS input, gold_sql AS output,
  CAST({words_text("question")} AS varchar) AS word_count, {type_text("question")} AS query_type,
  {difficulty_text("question", "gold_sql")} AS difficulty FROM sql_pairs"""
)
def corpus_sink(v: Views) -> DataFrame:
    """The labelled corpus written as CSV and read back as text."""
    path = scratch_path(v.spark, "labelled")
    corpus = v["sql_pairs"].select(
        F.col("question").alias("input"), F.col("gold_sql").alias("output")
    )
    columns = ["input", "output", "word_count", "query_type", "difficulty"]
    files.write_csv(label_corpus(corpus), path, columns)
    return files.read_corpus(v.spark, path).select(*columns)


@query(OUTCOMES + SUMMARY_LINES_SQL)
def summary_sink(v: Views) -> DataFrame:
    """The text report, written and read back line by line."""
    path = files.write_summary(summary_lines(outcomes(v)), scratch_path(v.spark, "results"))
    # One small file: its lines come back in order, and row ids number them.
    lines = v.spark.read.text(path).select(
        (F.monotonically_increasing_id() + 1).cast("int").alias("line_no"),
        F.col("value").alias("line"),
    )
    return lines
