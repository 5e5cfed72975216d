"""Building the warehouse: a folder of CSV files at once, or feeds season by season.

Tables are Parquet folders under one root. Tables with a season are partitioned by it,
so a season query reads its own partition and a season's upsert rewrites only that. Season
by season, a warehouse is stored in versions (see ``versions``): a season counts whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.cleaning import season_to_int
from courtside.operators.integrity import (
    REASONS,
    flag_rows,
    is_good,
    load_report,
    reject_samples,
    split,
    split_valid_batches,
)
from courtside.operators.keys import (
    OrderCols,
    allocate_ids,
    batch_conflicts,
    fresh_rows,
    insert_ignore,
    upsert,
)
from courtside.plans.versions import SEASON, Draft
from courtside.schemas import LOAD_ORDER, TABLES, TableSpec
from courtside.session import DROP_SHUFFLES, OPEN_FOLDERS, configured, pin, scratch_path
from courtside.sources.dims import event_message_types
from courtside.sources.feeds import (
    normalise_game,
    normalise_game_log,
    normalise_pbp,
    normalise_player,
    normalise_player_season,
    normalise_team,
    normalise_totals,
)
from courtside.sources.files import ARRIVAL, read_table_csv

TOTALS = "player_general_traditional_total"


def empty_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.createDataFrame([], spec.schema)


@dataclass
class CsvLoad:
    """What a CSV load left behind: tables, rejected rows, skipped tables, report."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejects: dict[str, DataFrame] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    report: DataFrame | None = None
    samples: DataFrame | None = None


def _with_ids(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Staged rows of a CSV with a row id each: the file's own, others above the highest of it."""
    if spec.serial not in rows.columns:
        return allocate_ids(rows, [ARRIVAL], 0, spec.serial)
    highest = rows.agg(F.max(spec.serial)).first()[0] or 0
    given = rows.where(F.col(spec.serial).isNotNull())
    unnumbered = rows.where(F.col(spec.serial).isNull()).drop(spec.serial)
    return given.unionByName(allocate_ids(unnumbered, [ARRIVAL], highest, spec.serial))


def load_all(
    spark: SparkSession,
    csv_dir: str,
    out_dir: str,
    order: list[str] = LOAD_ORDER,
    suffix: str = ".csv",
) -> CsvLoad:
    """Load a folder of table CSVs, parents first, replacing what is stored.

    Text is parsed once, into a typed staging table: the key checks read only its key
    columns, and the arrival numbers are fixed. Checked rows are written once too, good
    and rejected ones in separate partitions. Row ids a file gives are kept, a repeated one
    is rejected, and rows without one get the next ids. A missing file skips its table, which
    then counts as an empty parent.
    """
    load, staged = CsvLoad(), {}
    staging = scratch_path(spark, "staging")
    parents = {name: empty_table(spark, TABLES[name]) for name in TABLES}
    for name in order:
        spec = TABLES[name]
        try:
            rows = read_table_csv(spark, f"{csv_dir}/{name}{suffix}", spec)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            load.skipped.append(name)
            continue
        rows.write.parquet(f"{staging}/{name}")
        rows = spark.read.schema(rows.schema).parquet(f"{staging}/{name}")
        if spec.serial is not None:
            numbered = _with_ids(rows, spec)
            numbered.write.parquet(f"{staging}/{name}-ids")
            rows = spark.read.schema(numbered.schema).parquet(f"{staging}/{name}-ids")
        flagged = flag_rows(rows, spec, parents, [ARRIVAL]).withColumn("_ok", is_good())
        path = f"{out_dir}/{name}"
        partitions = ["_ok", SEASON] if SEASON in spec.columns else ["_ok"]
        # The wide rows stay where they are: a shuffle, or a sort that spills, would take several
        # times the table's space. Tasks read large splits, so that their files aren't many.
        with configured(spark, DROP_SHUFFLES | OPEN_FOLDERS):
            flagged.write.mode("overwrite").partitionBy(*partitions).parquet(path)
        columns = [F.col(c) for c in spec.columns]
        stored = spark.read.schema(flagged.schema).parquet(path)
        staged[name] = stored
        load.tables[name] = stored.filter(F.col("_ok")).select(*columns)
        load.rejects[name] = stored.filter(~F.col("_ok")).select(*columns, ARRIVAL, REASONS)
        parents[name] = load.tables[name]
    if staged:
        load.report = load_report(staged)
        load.samples = reject_samples(load.rejects, [ARRIVAL])
    return load


@dataclass
class SeasonInputs:
    """Raw frames of one season; ``order_cols`` is the arrival order in each frame."""

    season: str
    order_cols: OrderCols
    players: DataFrame | None = None
    games: DataFrame | None = None
    player_season: DataFrame | None = None
    totals: DataFrame | None = None
    game_log: DataFrame | None = None
    play_by_play: DataFrame | None = None


def _order_columns(order_cols: OrderCols) -> list[str]:
    if not all(isinstance(c, str) for c in order_cols):
        raise TypeError("order_cols of a season's inputs are column names")
    return list(order_cols)


def season_batches(
    state: dict[str, DataFrame], inputs: SeasonInputs
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A season's checked rows per table, and its rejects.

    ``state`` gives the parent tables before the season; players and games of the
    season count as loaded for its logs and events.
    """
    order = _order_columns(inputs.order_cols)
    arrival = tuple(order)
    batches: dict[str, DataFrame] = {}
    rejects: dict[str, DataFrame] = {}
    parents = dict(state)

    def checked(name: str, rows: DataFrame) -> None:
        good, bad = split(flag_rows(rows, TABLES[name], parents))
        batches[name], rejects[name] = good, bad

    def arrived(name: str, keys: list[str]) -> None:
        known = parents[name]
        parents[name] = known.select(*keys).unionByName(batches[name].select(*keys)).distinct()

    if inputs.players is not None:
        checked("player", normalise_player(inputs.players, order, flag=True))
        arrived("player", ["player_id"])
    if inputs.games is not None:
        checked("game", normalise_game(inputs.games, order, flag=True))
        arrived("game", ["game_id"])
    if inputs.player_season is not None:
        # The arrival order stays with the rows: of a repeated key the last one counts.
        rows = normalise_player_season(inputs.player_season, inputs.season, arrival, flag=True)
        checked("player_season", rows)
    if inputs.totals is not None:
        checked(TOTALS, normalise_totals(inputs.totals, inputs.season, arrival, flag=True))
    if inputs.game_log is not None:
        rows = normalise_game_log(inputs.game_log, parents["player"], arrival, flag=True)
        good, bad = split_valid_batches(rows, "player_id", TABLES["player_game_log"], parents)
        batches["player_game_log"], rejects["player_game_log"] = good, bad
    if inputs.play_by_play is not None:
        games = batches.get("game", parents["game"])
        rows = normalise_pbp(inputs.play_by_play, games, flag=True)
        good, bad = split_valid_batches(rows, "game_id", TABLES["play_by_play"], parents)
        batches["play_by_play"], rejects["play_by_play"] = good, bad
    return batches, rejects


def apply_season(
    state: dict[str, DataFrame], inputs: SeasonInputs
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after a season, as DataFrames, and the rejected rows.

    Players, games and logs already stored stay as they are; season statistics are
    replaced; events are appended, so a season applied twice repeats its events.
    """
    batches, rejects = season_batches(state, inputs)
    order = _order_columns(inputs.order_cols)
    after = dict(state)
    for name, keys in (("player", ["player_id"]), ("game", ["game_id"])):
        if name in batches:
            after[name] = insert_ignore(state[name], batches[name], keys, keys)
    for name in ("player_season", TOTALS):
        if name in batches:
            keys = list(TABLES[name].unique)
            after[name] = upsert(state[name], batches[name], keys, order)
    if "player_game_log" in batches:
        after["player_game_log"] = insert_ignore(
            state["player_game_log"],
            batches["player_game_log"],
            ["player_id", "game_id"],
            order,
        )
    if "play_by_play" in batches:
        after["play_by_play"] = state["play_by_play"].unionByName(
            batches["play_by_play"], allowMissingColumns=True
        )
    return after, rejects


class SeasonOutcome(dict[str, DataFrame]):
    """The rejected rows of each table of a season.

    ``applied`` is False if its batch had been applied before. ``conflicts`` counts, for
    the statistics, keys that came several times and the rows that lost to their last one:
    ``(table_name, repeated_keys, rows_replaced)``; None without statistics.
    """

    def __init__(
        self,
        rejects: dict[str, DataFrame] | None = None,
        applied: bool = True,
        conflicts: DataFrame | None = None,
    ) -> None:
        super().__init__(rejects or {})
        self.applied, self.conflicts = applied, conflicts


def read_warehouse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version in force; one that does not exist yet is empty."""
    return Draft(spark, root).read()


def store_season(
    spark: SparkSession, root: str, inputs: SeasonInputs, batch: str | None = None
) -> SeasonOutcome:
    """Apply a season to the stored warehouse and return the rejected rows.

    All of it takes effect at once, when the new version is told; a season that fails on
    the way changes nothing. A named ``batch`` is applied once: again, it is left alone.
    Without a name, players, games and logs already stored stay, statistics are replaced
    and events are repeated.

    Only new rows are written, and of the season statistics only the season's own part:
    the stored logs of other seasons are not read, but for their key columns. New rows of
    tables with row ids get the next ids; replaced rows keep theirs.
    """
    draft = Draft(spark, root)
    if batch is not None and batch in draft.base.batches:
        return SeasonOutcome(applied=False)
    state = draft.read()
    batches, rejects = season_batches(state, inputs)
    order = _order_columns(inputs.order_cols)
    conflicts = []
    for name, keys in (("player", ["player_id"]), ("game", ["game_id"])):
        if name in batches:
            draft.write(fresh_rows(state[name], batches[name], keys, keys), name)
    season = season_to_int(F.lit(inputs.season))
    for name in ("player_season", TOTALS):
        if name in batches:
            keys = list(TABLES[name].unique)
            stored = state[name].filter(F.col(SEASON) == season)
            merged = pin(upsert(stored, batches[name], keys, order))
            number = spark.range(1).select(season.alias("n")).first()["n"]
            draft.write(draft.with_ids(merged, name, state[name]), name, number)
            lost = batch_conflicts(batches[name], keys)
            conflicts.append(lost.select(F.lit(name).alias("table_name"), "*"))
    if "player_game_log" in batches:
        fresh = fresh_rows(
            state["player_game_log"],
            batches["player_game_log"],
            ["player_id", "game_id"],
            order,
            narrow_by="game_id",
        )
        draft.write(fresh, "player_game_log")
    if "play_by_play" in batches:
        events = pin(batches["play_by_play"].select(*TABLES["play_by_play"].loaded_columns))
        draft.write(draft.with_ids(events, "play_by_play", state["play_by_play"]), "play_by_play")
    draft.commit(batch)
    lost = reduce(DataFrame.unionByName, conflicts) if conflicts else None
    return SeasonOutcome(rejects, conflicts=lost)


def store_dimensions(spark: SparkSession, root: str, teams: DataFrame) -> None:
    """Store the teams and event types that aren't stored yet; both are small and constant."""
    draft = Draft(spark, root)
    state = draft.read()
    for name, rows in (
        ("team", normalise_team(teams)),
        ("event_message_type", event_message_types(spark)),
    ):
        key = list(TABLES[name].conflict_key)
        fresh = pin(fresh_rows(state[name], rows, key, key))
        if not fresh.isEmpty():
            draft.write(fresh, name)
    if draft.parts != list(draft.base.parts):
        draft.commit()


def build_warehouse(
    spark: SparkSession,
    root: str,
    teams: DataFrame,
    seasons: Iterable[SeasonInputs],
    name: str | None = None,
) -> list[SeasonOutcome]:
    """Dimensions first, then one season after another; each season's rejected rows.

    A build with a ``name`` can be run again after it broke off: seasons already applied
    under it are left alone. A season that comes twice in one build is applied twice.
    """
    store_dimensions(spark, root, teams)
    return [
        store_season(spark, root, s, None if name is None else f"{name}/{at}/{s.season}")
        for at, s in enumerate(seasons)
    ]
