"""From raw frames to warehouse rows: column alignment and the per-table normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.cleaning import (
    height_to_inches,
    real_overflows,
    safe_float,
    safe_int,
    season_to_int,
    stringify,
)
from courtside.operators.integrity import REASONS
from courtside.operators.keys import OrderCols, dedupe_first
from courtside.schemas import TABLES, TableSpec

# Feed column names that are not the upper-cased target name.
FEED_NAMES: dict[str, dict[str, str]] = {
    "game": {"team_id_home_id": "TEAM_ID", "date": "GAME_DATE"},
    "play_by_play": {
        "event_num": "EVENTNUM",
        "event_msg_type_id": "EVENTMSGTYPE",
        "event_msg_action_type": "EVENTMSGACTIONTYPE",
        "wc_time": "WCTIMESTRING",
        "home_description": "HOMEDESCRIPTION",
        "neutral_description": "NEUTRALDESCRIPTION",
        "visitor_description": "VISITORDESCRIPTION",
        "score_margin": "SCOREMARGIN",
    },
    "player_season": {"age": "PLAYER_AGE"},
    "player_general_traditional_total": {"fg3lm": "FG3M"},
}


def _source_names(df: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in df.columns}


def _converted(source: T.DataType, name: str, target: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(target, T.IntegerType):
        return safe_int(column)
    if isinstance(target, T.FloatType):
        return safe_float(column, source)
    if isinstance(target, T.DateType):
        return column.try_cast("date")
    return column.cast(target)


def _overflow(source: T.DataType, column: str, name: str, target: T.DataType) -> Column | None:
    """A reason if a number is read but doesn't fit the column; other bad text is NULL."""
    value = F.col(f"`{name}`")
    if isinstance(target, T.IntegerType):
        unread = value.isNotNull() & safe_int(value).isNull()
        if isinstance(source, T.StringType):
            beyond = unread & value.rlike(r"^\s*[+-]?\d+\s*$")
        elif isinstance(source, T.NumericType):
            size = F.abs(value.cast("double"))
            beyond = unread & ~F.isnan(size) & (size < float("inf"))
        else:
            return None
    elif isinstance(target, T.FloatType) and isinstance(source, (T.StringType, T.NumericType)):
        beyond = real_overflows(value)
    else:
        return None
    return F.when(beyond, F.lit(f"{column}: out of range of {target.simpleString()}"))


def align(
    df: DataFrame,
    spec: TableSpec,
    mapping: dict[str, str] | None = None,
    on_extra: str = "ignore",
    carry: tuple[str, ...] = (),
    flag: bool = False,
) -> DataFrame:
    """Project source columns to the table's columns, in order and typed.

    With ``flag`` rows get their reasons: the numbers that don't fit a column. A source column that is missing gives NULL. Extra source columns are ignored, or
    with ``on_extra='reject'`` every row gets a reason naming them. ``carry`` keeps
    helper columns (an arrival order, say) as they are.
    """
    if on_extra not in ("ignore", "reject"):
        raise ValueError(f"on_extra must be 'ignore' or 'reject', not {on_extra!r}")
    names = mapping or {}
    sources = _source_names(df)
    columns, reasons = [], []
    for column in spec.loaded_columns:
        target = spec.schema[column].dataType
        source = sources.get(names.get(column, column).lower())
        if source is None:
            value = F.lit(None).cast(target)
        else:
            value = _converted(df.schema[source].dataType, source, target)
            reasons.append(_overflow(df.schema[source].dataType, column, source, target))
        columns.append(value.alias(column))
    columns += [F.col(c) for c in carry]
    if on_extra == "reject":
        used = {names.get(c, c).lower() for c in spec.columns} | {c.lower() for c in carry}
        unknown = sorted(c for c in sources if c not in used)
        reasons = [*(reasons if flag else []), *[F.lit(f"unknown column: {c}") for c in unknown]]
    if flag or on_extra == "reject":
        found = F.array(*[r for r in reasons if r is not None])
        columns.append(F.array_compact(found.cast("array<string>")).alias(REASONS))
    return df.select(*columns)


def _feed(
    raw: DataFrame, table: str, carry: tuple[str, ...] = (), flag: bool = False
) -> DataFrame:
    return align(raw, TABLES[table], FEED_NAMES.get(table), carry=carry, flag=flag)


def normalise_team(df: DataFrame) -> DataFrame:
    """Team rows from a static list with ``id`` and ``year_founded``."""
    sources = _source_names(df)
    founded = (
        F.coalesce(F.col(sources["year_founded"]).cast("string"), F.lit(""))
        if "year_founded" in sources
        else F.lit("")
    )
    aligned = align(df, TABLES["team"], {"team_id": "id"} if "id" in sources else None)
    return aligned.withColumn("year_founded", founded)


def _ordered(raw: DataFrame, order_cols: OrderCols) -> tuple[DataFrame, tuple[str, ...]]:
    """Copy the arrival order to helper columns that survive alignment."""
    names = tuple(f"_order_{i}" for i in range(len(order_cols)))
    columns = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return raw.withColumns(dict(zip(names, columns))), names


def normalise_player(
    raw: DataFrame, order_cols: OrderCols, py_quirk: bool = False, flag: bool = False
) -> DataFrame:
    """Player rows; draft fields as text or NULL; the first row of a player wins."""
    sources = _source_names(raw)
    ordered, order = _ordered(raw, order_cols)
    draft = [c for c in ("draft_year", "draft_round", "draft_number") if c in sources]
    texts = {
        f"_{c}": stringify(sources[c], py_quirk, raw.schema[sources[c]].dataType) for c in draft
    }
    rows = _feed(ordered.withColumns(texts), "player", (*order, *texts), flag)
    rows = rows.withColumns({c: F.col(f"_{c}") for c in draft}).drop(*texts)
    return dedupe_first(rows, ["player_id"], order).drop(*order)


def normalise_game(raw: DataFrame, order_cols: OrderCols, flag: bool = False) -> DataFrame:
    """One row per game: the first seen gives the home team, the away team is NULL."""
    ordered, order = _ordered(raw, order_cols)
    rows = _feed(ordered, "game", order, flag)
    return dedupe_first(rows, ["game_id"], order).drop(*order)


def normalise_game_log(
    raw: DataFrame, players: DataFrame, carry: tuple[str, ...] = (), flag: bool = False
) -> DataFrame:
    """Typed log rows of players already loaded."""
    rows = _feed(raw, "player_game_log", carry, flag)
    return rows.join(players.select("player_id"), "player_id", "left_semi").select(
        *rows.columns
    )


def normalise_pbp(
    raw: DataFrame, games: DataFrame, carry: tuple[str, ...] = (), flag: bool = False
) -> DataFrame:
    """Typed event rows of games already loaded; repeats are kept."""
    rows = _feed(raw, "play_by_play", carry, flag)
    return rows.join(games.select("game_id"), "game_id", "left_semi").select(*rows.columns)


def _season_column(season: str | Column) -> Column:
    return season_to_int(F.lit(season) if isinstance(season, str) else season)


def normalise_player_season(
    raw: DataFrame, season: str | Column, carry: tuple[str, ...] = (), flag: bool = False
) -> DataFrame:
    """Bio statistics with the height in inches and the season's id."""
    labelled = raw.withColumn("_season_id", _season_column(season))
    rows = _feed(labelled, "player_season", ("_season_id", *carry), flag)
    return rows.withColumns(
        {
            "season_id": F.col("_season_id"),
            "player_height_inches": height_to_inches("player_height"),
        }
    ).drop("_season_id")


def normalise_totals(
    raw: DataFrame, season: str | Column, carry: tuple[str, ...] = (), flag: bool = False
) -> DataFrame:
    """Season totals; ``fg3lm`` repeats ``fg3m``."""
    labelled = raw.withColumn("_season_id", _season_column(season))
    rows = _feed(labelled, "player_general_traditional_total", ("_season_id", *carry), flag)
    return rows.withColumn("season_id", F.col("_season_id")).drop("_season_id")
