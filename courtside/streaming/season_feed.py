"""Landed feed files applied to the stored warehouse as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from courtside.plans.warehouse import SeasonInputs, store_season

FEEDS = ("players", "games", "player_season", "totals", "game_log", "play_by_play")


def season_feed(
    spark: SparkSession,
    landing: str,
    schema: str,
    root: str,
    checkpoint: str,
    order_cols: list[str],
    season: str,
    feed: str = "game_log",
) -> StreamingQuery:
    """Apply every new Parquet file of one of ``FEEDS``, then stop when none is left.

    A micro-batch is a named batch of the warehouse, known by the checkpoint folder and its
    number. One that is repeated after a failure changes nothing, events included: its rows
    and its name take effect together. Statistics replace those of the same player, logs
    already stored stay, each micro-batch after those before it.
    """
    if feed not in FEEDS:
        raise ValueError(f"no such feed: {feed}")
    raw = spark.readStream.schema(schema).parquet(landing)

    def apply(batch: DataFrame, number: int) -> None:
        inputs = SeasonInputs(season, order_cols, **{feed: batch})
        store_season(batch.sparkSession, root, inputs, f"{checkpoint}/{number}")

    return (
        raw.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_feed(
    spark: SparkSession,
    landing: str,
    schema: str,
    root: str,
    checkpoint: str,
    order_cols: list[str],
    season: str,
) -> StreamingQuery:
    """``season_feed`` of game logs: stored rows win, then the first to arrive."""
    return season_feed(spark, landing, schema, root, checkpoint, order_cols, season)
