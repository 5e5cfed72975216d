"""The nine warehouse tables: columns, keys, references and length limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    limits: dict[str, int] = field(default_factory=dict)
    serial: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def loaded_columns(self) -> list[str]:
        """Columns a loader supplies: everything but the generated id."""
        return [c for c in self.columns if c != self.serial]

    @property
    def conflict_key(self) -> tuple[str, ...]:
        """Columns that identify a row for conflict handling."""
        return self.unique or self.primary_key


_KINDS: dict[str, tuple[T.DataType, int | None]] = {
    "int": (T.IntegerType(), None),
    "serial": (T.LongType(), None),
    "real": (T.FloatType(), None),
    "text": (T.StringType(), None),
    "name": (T.StringType(), 255),
    "char": (T.StringType(), 1),
    "date": (T.DateType(), None),
}


def _table(
    name: str,
    columns: list[tuple[str, str]],
    *,
    primary_key: tuple[str, ...] = (),
    unique: tuple[str, ...] = (),
    references: dict[str, str] | None = None,
) -> TableSpec:
    """``columns`` pairs a kind with space-separated column names of that kind."""
    fields, limits, serial = [], {}, None
    for kind, names in columns:
        dtype, limit = _KINDS[kind]
        for column in names.split():
            fields.append(T.StructField(column, dtype))
            if limit is not None:
                limits[column] = limit
            if kind == "serial":
                serial = column
    foreign = tuple(
        ForeignKey(column, *target.split("."))
        for column, target in (references or {}).items()
    )
    return TableSpec(
        name,
        T.StructType(fields),
        primary_key,
        unique,
        foreign,
        primary_key,
        limits,
        serial,
    )


# Column names of the statistics tables.
BOX_SCORE = (
    "min fgm fga fg_pct fg3m fg3a fg3_pct ftm fta ft_pct oreb dreb reb ast tov "
    "stl blk pf pts plus_minus nba_fantasy_pts dd2 td3"
)
RANKED_STATS = (
    "gp w l w_pct min fgm fga fg_pct fg3m fg3a fg3_pct ftm fta ft_pct oreb dreb reb "
    "ast tov stl blk blka pf pfd pts plus_minus nba_fantasy_pts dd2 td3"
).split()

TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _table(
            "event_message_type",
            [("int", "id"), ("name", "string")],
            primary_key=("id",),
        ),
        _table(
            "team",
            [("int", "team_id"), ("name", "abbreviation nickname year_founded city")],
            primary_key=("team_id",),
        ),
        _table(
            "player",
            [
                ("int", "player_id"),
                ("name", "player_name college country draft_year draft_round draft_number"),
            ],
            primary_key=("player_id",),
        ),
        _table(
            "game",
            [
                ("text", "game_id"),
                ("int", "team_id_home_id team_id_away_id season_id"),
                ("date", "date"),
            ],
            primary_key=("game_id",),
            references={
                "team_id_home_id": "team.team_id",
                "team_id_away_id": "team.team_id",
            },
        ),
        _table(
            "play_by_play",
            [
                ("serial", "id"),
                ("text", "game_id"),
                ("int", "event_num event_msg_type_id event_msg_action_type period"),
                (
                    "name",
                    "wc_time home_description neutral_description visitor_description "
                    "score score_margin",
                ),
                (
                    "int",
                    "player1_id player1_team_id player2_id player2_team_id "
                    "player3_id player3_team_id",
                ),
            ],
            primary_key=("id",),
            references={
                "game_id": "game.game_id",
                "event_msg_type_id": "event_message_type.id",
                **{f"player{n}_id": "player.player_id" for n in (1, 2, 3)},
                **{f"player{n}_team_id": "team.team_id" for n in (1, 2, 3)},
            },
        ),
        _table(
            "player_game_log",
            [
                ("int", "player_id"),
                ("text", "game_id"),
                ("int", "team_id season_id"),
                ("char", "wl"),
                ("real", BOX_SCORE),
            ],
            primary_key=("player_id", "game_id"),
            references={
                "player_id": "player.player_id",
                "game_id": "game.game_id",
                "team_id": "team.team_id",
            },
        ),
        _table(
            "player_season",
            [
                ("serial", "id"),
                ("int", "player_id season_id team_id age"),
                ("name", "player_height"),
                ("int", "player_height_inches"),
                ("name", "player_weight"),
                (
                    "real",
                    "gp pts reb ast net_rating oreb_pct dreb_pct usg_pct ts_pct ast_pct",
                ),
            ],
            primary_key=("id",),
            unique=("player_id", "season_id"),
            references={"player_id": "player.player_id", "team_id": "team.team_id"},
        ),
        _table(
            "player_general_traditional_total",
            [
                ("serial", "id"),
                ("int", "player_id season_id team_id age gp w l"),
                (
                    "real",
                    "w_pct min fgm fga fg_pct fg3m fg3a fg3lm fg3_pct ftm fta ft_pct "
                    "oreb dreb reb ast tov stl blk blka pf pfd pts plus_minus "
                    "nba_fantasy_pts dd2 td3",
                ),
                ("int", " ".join(f"{stat}_rank" for stat in RANKED_STATS)),
                ("int", "cfid"),
                ("name", "cfparams"),
            ],
            primary_key=("id",),
            unique=("player_id", "season_id"),
            references={"player_id": "player.player_id"},
        ),
        _table(
            "player_career_totals",
            [
                ("int", "player_id seasons_played total_gp total_w total_l"),
                ("real", "career_w_pct total_min total_fgm total_fga career_fg_pct"),
                ("real", "total_fg3m total_fg3a career_fg3_pct"),
                ("real", "total_ftm total_fta career_ft_pct"),
                ("real", "total_oreb total_dreb total_reb total_ast total_tov total_stl"),
                ("real", "total_blk total_blka total_pf total_pfd total_pts"),
                ("real", "total_plus_minus total_nba_fantasy_pts total_dd2 total_td3"),
                ("real", "career_ppg career_rpg career_apg career_spg career_bpg career_topg"),
                ("int", "first_season last_season"),
            ],
            primary_key=("player_id",),
            references={"player_id": "player.player_id"},
        ),
    )
}

# Parents before children; the event log has no CSV file.
LOAD_ORDER = [
    "event_message_type",
    "team",
    "player",
    "game",
    "player_game_log",
    "player_season",
    "player_general_traditional_total",
    "player_career_totals",
]

# The CSV path truncates these by name, in whichever table they occur: every
# declared integer column except the event type id and the event number.
INT_COLUMNS = frozenset(
    f.name
    for spec in TABLES.values()
    for f in spec.schema
    if isinstance(f.dataType, T.IntegerType)
) - {"id", "event_num"}


def catalog_rows() -> list[tuple]:
    rows = []
    for spec in TABLES.values():
        parents = {fk.column: f"{fk.parent}.{fk.parent_column}" for fk in spec.foreign_keys}
        for position, f in enumerate(spec.schema, start=1):
            rows.append(
                (
                    spec.name,
                    position,
                    f.name,
                    f.dataType.simpleString(),
                    f.name in spec.primary_key,
                    f.name in spec.unique,
                    parents.get(f.name),
                    spec.limits.get(f.name),
                )
            )
    return rows


CATALOG_SCHEMA = (
    "table_name string, position int, column_name string, data_type string, "
    "in_primary_key boolean, in_unique boolean, parent string, max_length int"
)


def catalog_df(spark: SparkSession) -> DataFrame:
    """One row per declared column."""
    return spark.createDataFrame(catalog_rows(), CATALOG_SCHEMA)
