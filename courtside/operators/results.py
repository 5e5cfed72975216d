"""Comparing result sets held in long form: ``(example_id, side, row array<string>)``.

``side`` is ``gold`` or ``pred``. Any number of examples is compared in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.cleaning import strip_plain
from courtside.session import broadcast_if_small, pin

GOLD, PRED = "gold", "pred"


def row_array(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row's values as stripped text, missing ones as empty text."""
    names = df.columns if columns is None else columns

    def text(name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.StringType):
            return strip_plain(name)
        return F.col(f"`{name}`").cast("string")

    values = [F.coalesce(text(c), F.lit("")) for c in names]
    return F.array(*values).cast("array<string>")


def exact_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row's values as text, missing ones as NULL."""
    names = df.columns if columns is None else columns
    return F.array(*[F.col(f"`{c}`").cast("string") for c in names]).cast("array<string>")


def value_row(df: DataFrame) -> Column:
    """A row's values as they are, as text: missing ones as NULL, texts not stripped.

    Equal numbers have equal texts whatever their type, ``1``, ``1.00`` and ``1.0`` alike.
    """

    def text(name: str) -> Column:
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            shorter = F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1")
            return F.regexp_replace(shorter, r"\.$", "")
        if isinstance(kind, T.DoubleType | T.FloatType):
            whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
            return F.when(whole, column.cast("decimal(20,0)").cast("string")).otherwise(
                column.cast("string")
            )
        return column.cast("string")

    return F.array(*[text(c) for c in df.columns]).cast("array<string>")


def normalise_rows(
    df: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Result rows in comparable form; ``keep`` columns (an example id) stay."""
    values = [c for c in df.columns if c not in keep] if columns is None else columns
    return df.select(*keep, row_array(df, values).alias("row"))


def _signed_counts(long_df: DataFrame, by: Sequence[str]) -> DataFrame:
    sign = F.when(F.col("side") == GOLD, 1).otherwise(-1)
    # Equal rows cancel. The sum combines before the shuffle, so neither an example
    # with most of the rows nor one row repeated many times lands on one task.
    return long_df.groupBy("example_id", *by).agg(F.sum(sign).alias("_diff"))


def _verdicts(differences: DataFrame, examples: DataFrame | None) -> DataFrame:
    equal = differences.groupBy("example_id").agg(
        F.every(F.col("_diff") == 0).cast("int").alias("correct")
    )
    if examples is None:
        return equal
    # An example whose two results are both empty has no rows; they are equal.
    return (
        examples.select("example_id")
        .join(equal, "example_id", "left")
        .select("example_id", F.coalesce("correct", F.lit(1)).alias("correct"))
    )


def compare_results(long_df: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """1 where both sides hold the same bag of rows, whatever their order."""
    return _verdicts(_signed_counts(long_df, ["row"]), examples)


def compare_ordered(long_df: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """1 where both sides hold the same rows at the same ``pos``."""
    return _verdicts(_signed_counts(long_df, ["pos", "row"]), examples)


def sums_of(rows: DataFrame, by: str, ordered: bool = False) -> DataFrame:
    """``by``, and ``sums``: the number of its rows and a sum over hashes of them.

    Equal results have equal sums, so unequal ones tell results apart without moving a row;
    equal ones prove nothing.
    """
    hashed = F.xxhash64("pos", "row") if ordered else F.xxhash64("row")
    # Decimals, as sums of longs would overflow.
    total = F.sum(hashed.cast("decimal(20,0)"))
    return rows.groupBy(by).agg(F.struct(F.count("*").alias("n"), total.alias("hash")).alias("sums"))


def gapless_positions(
    rows: DataFrame, by: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Replace row ids in ``name`` by 1..n in their order, for each value of ``by``.

    ``rows`` must be stored: they are read twice, for the rows under each partition number
    that the ids hold, and for themselves. Nothing sorts, gathers or shuffles them: the
    offsets have one row per partition of the job that gave the ids, and are broadcast.
    """
    marked = rows.withColumn("_part", F.shiftright(name, 33))
    counts = marked.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min(name).alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col(name) - F.col("_first") + 1
    known = broadcast_if_small(pin(offsets))
    return marked.join(known, [*by, "_part"]).withColumn(name, place).drop("_part", "_first", "_before")


def with_positions(sorted_df: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of a sorted, pinned result 1..n (see ``session.pin``)."""
    return gapless_positions(sorted_df.withColumn(name, F.monotonically_increasing_id()), (), name)


def result_preview(
    long_df: DataFrame,
    headers: DataFrame,
    max_rows: int = 50,
    counts: DataFrame | None = None,
) -> DataFrame:
    """A short text of each example's result.

    ``long_df`` holds ``(example_id, pos, row)``, ``headers`` one ``(example_id,
    header array<string>)`` row per example. At most ``max_rows`` rows per example are
    gathered; the others are counted by an aggregate, or given as ``counts`` of
    ``(example_id, _n)`` where ``long_df`` holds only the first rows.
    """
    first = Window.partitionBy("example_id").orderBy("pos")
    shown = (
        long_df.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= max_rows)
        .groupBy("example_id")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "row"))).alias("_rows"))
    )
    if counts is None:
        counts = long_df.groupBy("example_id").agg(F.count("*").alias("_n"))

    def line(values: Column) -> Column:
        return F.array_join(values, " | ", "")

    rows = F.coalesce(F.col("_rows"), F.array().cast("array<struct<_rn:int,row:array<string>>>"))
    hidden = F.coalesce(F.col("_n"), F.lit(0)) - max_rows
    more = F.when(
        hidden > 0,
        F.array(F.concat(F.lit("... ("), hidden.cast("string"), F.lit(" rows not shown)"))),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(line(F.col("header")), F.lit("-" * 20)),
        F.transform(rows, lambda r: line(r.row)),
        more,
        F.array(F.lit("")),
    )
    text = F.when(
        F.coalesce(F.size("header"), F.lit(0)) <= 0, "(no rows returned)"
    ).otherwise(F.array_join(lines, "\n"))
    return (
        headers.join(counts, "example_id", "left")
        .join(shown, "example_id", "left")
        .select("example_id", text.alias("preview"))
    )
