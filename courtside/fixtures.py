"""Warehouse-shaped views over the driver's tables.

Part stands for player, nation for team, order for game and line item for game log.
``Views`` builds them as DataFrames; ``with_views`` gives the same views as SQL
common table expressions for the check engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.keys import dedupe_first
from courtside.session import spread
from courtside.sources.dims import EVENT_MESSAGE_TYPES, event_message_types

ARRIVAL = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
FACTS = {"lineitem", "orders", "events", "conversations"}
LOG_STATS = "pts reb ast tov blk stl pf fgm fga fg3m fg3a".split()
PGTT = "player_general_traditional_total"
# Tasks for the lines of one split, which unpack to many times its size.
_TASKS_A_SPLIT = 8
STORED = ["team", "player", "game", "player_game_log", PGTT, "player_season"]


def padded(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 10, "0")


def game_logs(lines: DataFrame) -> DataFrame:
    """Game logs made of order lines, with their arrival order."""
    line, threes = F.col("l_linenumber"), F.round(F.col("l_discount") * 100)
    made = F.floor(F.col("l_quantity") / 3)
    stats = {
        "pts": F.col("l_quantity"),
        "reb": F.floor(F.col("l_quantity") / 4),
        "ast": F.round(F.col("l_tax") * 100),
        "tov": line,
        "blk": threes,
        "stl": line % 4,
        "pf": line % 6,
        "fgm": made,
        "fga": made + line,
        "fg3m": threes,
        "fg3a": threes + line,
    }
    return lines.select(
        F.col("l_partkey").cast("int").alias("player_id"),
        padded("l_orderkey").alias("game_id"),
        F.col("s_nationkey").alias("team_id"),
        "season_id",
        F.when(F.col("o_orderstatus") == "F", "W")
        .when(F.col("o_orderstatus") == "O", "L")
        .alias("wl"),
        *[value.cast("float").alias(name) for name, value in stats.items()],
        *ARRIVAL,
    )


class Views(dict):
    """Lazily built views of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def base(self, table: str) -> DataFrame:
        scan = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return spread(scan) if table in FACTS else scan

    def __missing__(self, name: str) -> DataFrame:
        view = getattr(self, f"_{name}")()
        self[name] = view
        return view

    def stored(self, root: str, names: Sequence[str] = STORED) -> Views:
        """The named tables written under ``root``, each built from those before.

        Their rows are written where they are: the partitions of the last join or aggregate
        are large enough for a file a season.
        """
        tables = Views(self.spark, self.folder)
        for name in names:
            view = tables[name]
            keys = ["season_id"] if "season_id" in view.columns else []
            writer = view.write
            path = f"{root}/{name}"
            (writer.partitionBy(*keys) if keys else writer).parquet(path)
            tables[name] = self.spark.read.schema(view.schema).parquet(path)
        return tables

    def _event_message_type(self) -> DataFrame:
        return event_message_types(self.spark)

    def _team(self) -> DataFrame:
        joined = self.base("nation").join(
            self.base("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return joined.select(
            F.col("n_nationkey").alias("team_id"),
            F.concat(F.lit("T"), "n_nationkey").alias("abbreviation"),
            F.col("n_name").alias("nickname"),
            (F.col("n_nationkey") + 1946).cast("string").alias("year_founded"),
            F.col("r_name").alias("city"),
        )

    def _player(self) -> DataFrame:
        drafted = F.col("p_size") >= 5
        return self.base("part").select(
            F.col("p_partkey").cast("int").alias("player_id"),
            F.concat_ws(" ", "p_name", "p_partkey").alias("player_name"),
            F.col("p_brand").alias("college"),
            F.col("p_type").alias("country"),
            F.when(drafted, (F.col("p_size") + 1970).cast("string"))
            .otherwise("Undrafted")
            .alias("draft_year"),
            F.when(drafted, (F.col("p_size") % 2 + 1).cast("string")).alias("draft_round"),
            F.when(drafted, F.col("p_size").cast("string")).alias("draft_number"),
        )

    def _game(self) -> DataFrame:
        joined = self.base("orders").join(
            self.base("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        return joined.select(
            padded("o_orderkey").alias("game_id"),
            F.col("c_nationkey").alias("team_id_home_id"),
            F.lit(None).cast("int").alias("team_id_away_id"),
            (F.year("o_orderdate") + 20000).cast("int").alias("season_id"),
            F.to_date("o_orderdate").alias("date"),
        )

    def _log_lines(self, together: bool = False) -> DataFrame:
        """Order lines with what the game logs need of their order and supplier.

        ``together`` brings the lines of an order into one task, of as many tasks as keep
        their sorts small where the session's number is too low for the input.
        """
        orders = self.base("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
        suppliers = self.base("supplier").select("s_suppkey", "s_nationkey")
        lines = self.base("lineitem")
        tasks = _TASKS_A_SPLIT * lines.rdd.getNumPartitions()
        # Orders come last, so that the lines stay as that join brings them together.
        lines = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        if together and tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            lines = lines.repartition(tasks, "l_orderkey")
            orders = orders.repartition(tasks, "o_orderkey")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        season = (F.year("o_orderdate") + 20000).cast("int").alias("season_id")
        values = ["l_quantity", "l_discount", "l_tax"]
        keys = ["l_orderkey", "l_partkey", "s_nationkey"]
        return joined.select(*keys, season, "o_orderstatus", *values, *ARRIVAL)

    def _raw_game_log(self) -> DataFrame:
        return game_logs(self._log_lines())

    def _player_game_log(self) -> DataFrame:
        # A game lies in one season, so season_id adds nothing to the key; it lets a
        # season filter move below the window, down to the orders scan. The order stands for
        # the game: since the join its lines are together and needn't be shuffled again, and
        # they are narrower than the logs made of them.
        together = self._log_lines(together=True)
        lines = dedupe_first(together, ["l_orderkey", "l_partkey", "season_id"], ARRIVAL)
        first = game_logs(lines)
        # Only orders of more than ten characters may share a game_id, which is cut to ten.
        order = F.col("o_orderkey")
        long = self.base("orders").where((order > 9_999_999_999) | (order < -999_999_999))
        if not long.isEmpty():
            first = dedupe_first(first, ["player_id", "game_id", "season_id"], ARRIVAL)
        return first.drop(*ARRIVAL)

    def _player_general_traditional_total(self) -> DataFrame:
        sums = {s: F.sum(F.col(s).cast("double")) for s in LOG_STATS}
        won, lost = F.col("wl") == "W", F.col("wl") == "L"
        return (
            self["player_game_log"]
            .groupBy("player_id", "season_id")
            .agg(
                F.min("team_id").alias("team_id"),
                F.count("*").cast("int").alias("gp"),
                F.count_if(won).cast("int").alias("w"),
                F.count_if(lost).cast("int").alias("l"),
                *[total.cast("float").alias(s) for s, total in sums.items()],
                F.when(sums["fg3a"] > 0, sums["fg3m"] / sums["fg3a"])
                .cast("float")
                .alias("fg3_pct"),
            )
        )

    def _player_season(self) -> DataFrame:
        def per_game(stat: str) -> Column:
            return (F.col(stat).cast("double") / F.col("gp")).cast("float").alias(stat)

        return self[PGTT].select(
            "player_id",
            "season_id",
            "team_id",
            F.col("gp").cast("float").alias("gp"),
            per_game("pts"),
            per_game("reb"),
            per_game("ast"),
        )

    def _play_by_play(self) -> DataFrame:
        kind = F.col("event_type")
        return self.base("events").select(
            F.lpad((F.col("event_id") % 1000).cast("string"), 10, "0").alias("game_id"),
            F.col("event_id").alias("event_num"),
            F.when(kind == "click", 1)
            .when(kind == "view", 2)
            .when(kind == "purchase", 3)
            .when(kind == "error", 5)
            .otherwise(8)
            .alias("event_msg_type_id"),
            (F.col("event_id") % 4 + 1).cast("int").alias("period"),
            F.col("user_id").cast("int").alias("player1_id"),
        )

    def _text_pairs(self) -> DataFrame:
        turns = self.base("conversations")
        asked = turns.filter(F.col("role") == "user").select(
            "conv_id", "turn", F.col("text").alias("gold")
        )
        answered = turns.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred")
        )
        return asked.join(answered, ["conv_id", "turn"])

    def _sql_pairs(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        full = F.concat(
            F.lit("SELECT o_totalprice FROM orders WHERE o_custkey = "),
            customer,
            F.lit(" AND o_orderstatus = '"),
            F.col("o_orderstatus"),
            F.lit("' ORDER BY o_orderdate DESC LIMIT "),
            (key % 9 + 1).cast("string"),
            F.lit(";"),
        )
        questions = [
            "top 5 scorers in 1997",
            "how many games in the season",
            "who had the best season",
            "which team improved over time since the first year on record",
            "list all games",
            "compare wins vs losses",
            "players that shine",
        ]
        replies = [
            F.concat(
                F.lit("```sql SELECT o_totalprice FROM orders WHERE o_custkey = "),
                customer,
                F.lit("; ``` done"),
            ),
            F.concat(
                F.lit("A: SELECT count(*) FROM orders GROUP BY o_custkey HAVING count(*) > "),
                (key % 5).cast("string"),
            ),
            F.concat(
                F.lit(
                    "Sure! select max(o_totalprice) from orders /* c */ where o_custkey in ("
                ),
                customer,
                F.lit(") -- note"),
            ),
            F.lit("I cannot answer"),
            F.lit(""),
            full,
        ]
        errors = [
            'syntax error at or near "FROM"',
            'relation "x" does not exist',
            'column "x" does not exist',
            'column reference "id" is ambiguous',
            'missing FROM-clause entry for table "z"',
            "operator does not exist: text = integer",
            "function f() does not exist",
            "canceling statement due to statement timeout",
            "",
        ]

        def pick(values: list) -> Column:
            options = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
            return options[(key % len(values)).cast("int")]

        return self.base("orders").select(
            key.alias("example_id"),
            pick(questions).alias("question"),
            full.alias("gold_sql"),
            pick(replies).alias("reply"),
            pick(errors).alias("err"),
        )

    def _dirty_values(self) -> DataFrame:
        key = F.col("o_orderkey")
        digit, sixth, fifth = key % 10, key % 6, key % 5
        start = key % 28
        return self.base("orders").select(
            key.alias("id"),
            F.when(digit == 0, "")
            .when(digit == 1, " 12 ")
            .when(digit == 2, "12.5")
            .when(digit == 3, "abc")
            .when(digit == 4, "NaN")
            .when(digit == 5, F.lit(None).cast("string"))
            .when(digit == 6, "  ")
            .when(digit == 7, "NA")
            .otherwise(F.col("o_custkey").cast("string"))
            .alias("v"),
            F.when(sixth == 0, "6-5-3")
            .when(sixth == 1, "abc-5")
            .when(sixth == 2, "-5")
            .when(sixth == 3, "72")
            .otherwise(F.concat_ws("-", key % 3 + 5, key % 12))
            .alias("height"),
            F.when(fifth == 0, "x")
            .when(fifth == 1, "2023")
            .otherwise(
                F.concat_ws(
                    "-", start + 1996, F.lpad(((start + 1997) % 100).cast("string"), 2, "0")
                )
            )
            .alias("season"),
        )


_EVENT_VALUES = ", ".join(f"({i}, '{name}')" for i, name in EVENT_MESSAGE_TYPES)

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "event_message_type": ((), f"SELECT * FROM (VALUES {_EVENT_VALUES}) AS t(id, string)"),
    "team": (
        (),
        """
SELECT n_nationkey AS team_id, concat('T', n_nationkey) AS abbreviation, n_name AS nickname,
  CAST(1946 + n_nationkey AS varchar) AS year_founded, r_name AS city
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "player": (
        (),
        """
SELECT CAST(p_partkey AS int) AS player_id, concat(p_name, ' ', p_partkey) AS player_name,
  p_brand AS college, p_type AS country,
  CASE WHEN p_size < 5 THEN 'Undrafted' ELSE CAST(1970 + p_size AS varchar) END AS draft_year,
  CASE WHEN p_size < 5 THEN NULL ELSE CAST(1 + p_size % 2 AS varchar) END AS draft_round,
  CASE WHEN p_size < 5 THEN NULL ELSE CAST(p_size AS varchar) END AS draft_number
FROM part""",
    ),
    "game": (
        (),
        """
SELECT lpad(CAST(o_orderkey AS varchar), 10, '0') AS game_id, c_nationkey AS team_id_home_id,
  CAST(NULL AS int) AS team_id_away_id, CAST(20000 + year(o_orderdate) AS int) AS season_id,
  CAST(o_orderdate AS date) AS date
FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "raw_game_log": (
        (),
        """
SELECT CAST(l_partkey AS int) AS player_id, lpad(CAST(l_orderkey AS varchar), 10, '0') AS game_id,
  s_nationkey AS team_id, CAST(20000 + year(o_orderdate) AS int) AS season_id,
  CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'O' THEN 'L' END AS wl,
  CAST(l_quantity AS float) AS pts, CAST(floor(l_quantity / 4) AS float) AS reb,
  CAST(round(l_tax * 100) AS float) AS ast, CAST(l_linenumber AS float) AS tov,
  CAST(round(l_discount * 100) AS float) AS blk, CAST(l_linenumber % 4 AS float) AS stl,
  CAST(l_linenumber % 6 AS float) AS pf, CAST(floor(l_quantity / 3) AS float) AS fgm,
  CAST(floor(l_quantity / 3) + l_linenumber AS float) AS fga,
  CAST(round(l_discount * 100) AS float) AS fg3m,
  CAST(round(l_discount * 100) + l_linenumber AS float) AS fg3a,
  l_linenumber, l_suppkey, l_extendedprice, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "player_game_log": (
        ("raw_game_log",),
        """
SELECT player_id, game_id, team_id, season_id, wl, pts, reb, ast, tov, blk, stl, pf, fgm, fga,
  fg3m, fg3a
FROM (SELECT *, row_number() OVER (PARTITION BY player_id, game_id
        ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM raw_game_log) t
WHERE rn = 1""",
    ),
    PGTT: (
        ("player_game_log",),
        """
SELECT player_id, season_id, min(team_id) AS team_id, CAST(count(*) AS int) AS gp,
  CAST(sum(CASE WHEN wl = 'W' THEN 1 ELSE 0 END) AS int) AS w,
  CAST(sum(CASE WHEN wl = 'L' THEN 1 ELSE 0 END) AS int) AS l,
  CAST(sum(pts) AS float) AS pts, CAST(sum(reb) AS float) AS reb, CAST(sum(ast) AS float) AS ast,
  CAST(sum(tov) AS float) AS tov, CAST(sum(blk) AS float) AS blk, CAST(sum(stl) AS float) AS stl,
  CAST(sum(pf) AS float) AS pf, CAST(sum(fgm) AS float) AS fgm, CAST(sum(fga) AS float) AS fga,
  CAST(sum(fg3m) AS float) AS fg3m, CAST(sum(fg3a) AS float) AS fg3a,
  CASE WHEN sum(fg3a) > 0 THEN CAST(sum(fg3m) / sum(fg3a) AS float) END AS fg3_pct
FROM player_game_log GROUP BY player_id, season_id""",
    ),
    "player_season": (
        (PGTT,),
        """
SELECT player_id, season_id, team_id, CAST(gp AS float) AS gp,
  CAST(CAST(pts AS double) / gp AS float) AS pts, CAST(CAST(reb AS double) / gp AS float) AS reb,
  CAST(CAST(ast AS double) / gp AS float) AS ast
FROM player_general_traditional_total""",
    ),
    "play_by_play": (
        (),
        """
SELECT lpad(CAST(event_id % 1000 AS varchar), 10, '0') AS game_id, event_id AS event_num,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
    WHEN 'error' THEN 5 ELSE 8 END AS event_msg_type_id,
  CAST(1 + event_id % 4 AS int) AS period, CAST(user_id AS int) AS player1_id
FROM events""",
    ),
    "text_pairs": (
        (),
        """
SELECT a.conv_id AS conv_id, a.turn AS turn, a.text AS gold, b.text AS pred
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""",
    ),
    "sql_pairs": (
        (),
        """
SELECT o_orderkey AS example_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'top 5 scorers in 1997' WHEN 1 THEN 'how many games in the season'
    WHEN 2 THEN 'who had the best season'
    WHEN 3 THEN 'which team improved over time since the first year on record'
    WHEN 4 THEN 'list all games' WHEN 5 THEN 'compare wins vs losses'
    ELSE 'players that shine' END AS question,
  concat('SELECT o_totalprice FROM orders WHERE o_custkey = ', o_custkey, ' AND o_orderstatus = ''',
    o_orderstatus, ''' ORDER BY o_orderdate DESC LIMIT ', 1 + o_orderkey % 9, ';') AS gold_sql,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('```sql SELECT o_totalprice FROM orders WHERE o_custkey = ', o_custkey,
      '; ``` done')
    WHEN 1 THEN concat('A: SELECT count(*) FROM orders GROUP BY o_custkey HAVING count(*) > ',
      o_orderkey % 5)
    WHEN 2 THEN concat('Sure! select max(o_totalprice) from orders /* c */ where o_custkey in (',
      o_custkey, ') -- note')
    WHEN 3 THEN 'I cannot answer' WHEN 4 THEN ''
    ELSE concat('SELECT o_totalprice FROM orders WHERE o_custkey = ', o_custkey,
      ' AND o_orderstatus = ''', o_orderstatus, ''' ORDER BY o_orderdate DESC LIMIT ',
      1 + o_orderkey % 9, ';') END AS reply,
  CASE o_orderkey % 9 WHEN 0 THEN 'syntax error at or near "FROM"'
    WHEN 1 THEN 'relation "x" does not exist' WHEN 2 THEN 'column "x" does not exist'
    WHEN 3 THEN 'column reference "id" is ambiguous'
    WHEN 4 THEN 'missing FROM-clause entry for table "z"'
    WHEN 5 THEN 'operator does not exist: text = integer' WHEN 6 THEN 'function f() does not exist'
    WHEN 7 THEN 'canceling statement due to statement timeout' ELSE '' END AS err
FROM orders""",
    ),
    "dirty_values": (
        (),
        """
SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN '12.5'
    WHEN 3 THEN 'abc' WHEN 4 THEN 'NaN' WHEN 5 THEN CAST(NULL AS varchar) WHEN 6 THEN '  '
    WHEN 7 THEN 'NA' ELSE CAST(o_custkey AS varchar) END AS v,
  CASE o_orderkey % 6 WHEN 0 THEN '6-5-3' WHEN 1 THEN 'abc-5' WHEN 2 THEN '-5' WHEN 3 THEN '72'
    ELSE concat(5 + o_orderkey % 3, '-', o_orderkey % 12) END AS height,
  CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '2023'
    ELSE concat(1996 + o_orderkey % 28, '-',
      lpad(CAST((1997 + o_orderkey % 28) % 100 AS varchar), 2, '0')) END AS season
FROM orders""",
    ),
}


def with_views(*names: str, **extra: str) -> str:
    """A WITH clause holding the named views, what they need, and ``extra`` ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in VIEW_SQL[name][0]:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({VIEW_SQL[name][1]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
