"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.session import stored as stored


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str | Column],
    how: str = "inner",
    salts: int = 8,
) -> DataFrame:
    """Join ``few`` (one narrow row per key) to ``many``, whose keys may be very common.

    Every row of ``few`` is repeated ``salts`` times and the rows of a key in ``many`` are
    dealt over as many keys by a hash of ``spread_by``, so that a key with a third of all
    rows reaches ``salts`` tasks.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def numbered(
    df: DataFrame, group: str, cell: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """Gapless numbers from 0 inside every ``group``, in the order of ``cell``, then ``order``.

    ``cell`` cuts a group into parts of bounded size: rows are numbered inside a part and
    shifted by the rows of the parts before it, so no task sorts a whole group.
    """
    from pyspark.sql import Window

    sizes = df.groupBy(group, *cell).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, *cell, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(group, *cell).orderBy(*order)) - 1
    return (
        df.withColumn("_row", inside)
        .join(offsets, [group, *cell])
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
        .drop("_row", "_before")
    )
