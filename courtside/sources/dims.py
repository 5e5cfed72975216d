"""Constant dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event type ids and their names.
EVENT_MESSAGE_TYPES = [
    (1, "Made Shot"),
    (2, "Missed Shot"),
    (3, "Free Throw"),
    (4, "Rebound"),
    (5, "Turnover"),
    (6, "Foul"),
    (7, "Violation"),
    (8, "Substitution"),
    (9, "Timeout"),
    (10, "Jump Ball"),
    (11, "Ejection"),
    (12, "Start Period"),
    (13, "End Period"),
    (18, "Instant Replay"),
    (20, "Stoppage: Out-of-Bounds"),
]


def event_message_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_MESSAGE_TYPES, "id int, string string")
