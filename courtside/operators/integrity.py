"""Row checks: domains, NOT NULL, duplicate keys and foreign keys.

Every check adds texts to a ``_reasons`` array; a row with an empty array is good.
Nothing is dropped: a split returns both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.operators.keys import OrderCols
from courtside.schemas import TableSpec
from courtside.session import broadcast_if_small, is_small, pin, stored

REASONS = "_reasons"


def _add(df: DataFrame, reasons: Sequence[Column]) -> DataFrame:
    """Append the non-NULL reason texts to the row's list. Lists are built only where there are any."""
    before = F.col(REASONS) if REASONS in df.columns else F.array().cast("array<string>")
    if not reasons:
        return df.withColumn(REASONS, before)
    found = F.concat(before, F.array_compact(F.array(*reasons)).cast("array<string>"))
    some = F.coalesce(*reasons).isNotNull()
    return df.withColumn(REASONS, F.when(some, found).otherwise(before))


def is_good() -> Column:
    return F.size(REASONS) == 0


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flagged.filter(is_good()).drop(REASONS), flagged.filter(~is_good())


def domain_reasons(df: DataFrame, spec: TableSpec) -> list[Column]:
    """Length limits, and values that the declared number types cannot hold."""
    reasons = []
    for f in spec.schema:
        if f.name not in df.columns:
            continue
        source, column = df.schema[f.name].dataType, F.col(f.name)
        if f.name in spec.limits:
            too_long = F.char_length(column.cast("string")) > spec.limits[f.name]
            reasons.append(F.when(too_long, f"{f.name}: too long"))
        elif source != f.dataType and isinstance(
            f.dataType, (T.IntegerType, T.FloatType, T.DateType)
        ):
            unreadable = column.isNotNull() & column.try_cast(f.dataType).isNull()
            kind = f.dataType.simpleString()
            reasons.append(F.when(unreadable, f"{f.name}: not a valid {kind}"))
    return reasons


def domain_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that break a column limit, with the list of reasons."""
    return _add(df, domain_reasons(df, spec)).filter(~is_good())


def not_null_reasons(spec: TableSpec) -> list[Column]:
    return [
        F.when(F.col(c).isNull(), f"{c}: null key") for c in spec.not_null if c != spec.serial
    ]


def _key_structs(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> list:
    return [fk for fk in spec.foreign_keys if fk.parent in parents and fk.column in df.columns]


def orphan_keys(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> DataFrame:
    """Distinct (column, key) pairs that have no parent row. NULLs are no orphans.

    One scan of the child's key columns, de-duplicated before the shuffle, feeds one
    anti-join against all parents.
    """
    keys = _key_structs(df, spec, parents)
    pair = [
        F.struct(F.lit(fk.column).alias("fk"), F.col(fk.column).cast("string").alias("key"))
        for fk in keys
    ]
    used = (
        df.select(F.explode(F.array(*pair)).alias("p"))
        .select("p.fk", "p.key")
        .filter(F.col("key").isNotNull())
        .distinct()
    )
    known = reduce(
        DataFrame.unionByName,
        [
            parents[fk.parent].select(
                F.lit(fk.column).alias("fk"),
                F.col(fk.parent_column).cast("string").alias("key"),
            )
            for fk in keys
        ],
    )
    return used.join(known, ["fk", "key"], "left_anti")


def flag_orphans(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> DataFrame:
    """Add a reason for each foreign key without a parent.

    The orphan keys are few in a sane feed: once counted they are broadcast and the
    wide child rows are not shuffled. Beyond the limit those of each column are counted,
    whose limit is higher; beyond that it is an ordinary join.
    """
    keys = _key_structs(df, spec, parents)
    if not keys:
        return _add(df, [])
    orphans = stored(orphan_keys(df, spec, parents), "orphans")
    all_small = is_small(orphans)
    out, reasons = df, []
    for fk in keys:
        mark = f"_orphan_{fk.column}"
        one = orphans.filter(F.col("fk") == fk.column).select(F.col("key").alias(mark))
        one = F.broadcast(one) if all_small else broadcast_if_small(one)
        out = out.join(one, F.col(fk.column).cast("string") == F.col(mark), "left")
        reasons.append(
            F.when(F.col(mark).isNotNull(), f"{fk.column}: no such {fk.parent}")
        )
    return _add(out, reasons).drop(*[f"_orphan_{fk.column}" for fk in keys])


def flag_duplicates(df: DataFrame, keys: Sequence[str], order_cols: OrderCols) -> DataFrame:
    """Add a reason to every good row whose key an earlier good row already has.

    The first arrival per repeated key is found by an aggregate that combines before
    the shuffle; only repeated keys are joined back. ``order_cols`` must tell any two
    rows of a key apart.
    """
    arrival = F.struct(*order_cols)
    eligible = df.filter(is_good()) if REASONS in df.columns else df
    repeated = stored(
        eligible.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min(arrival).alias("_first"))
        .filter(F.col("_n") > 1)
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_first"),
        "repeated",
    )
    joined = df.join(
        broadcast_if_small(repeated), [F.col(k) == F.col(f"_key_{k}") for k in keys], "left"
    )
    later = F.col("_first").isNotNull() & (arrival > F.col("_first"))
    if REASONS in df.columns:
        later = later & is_good()
    name = ", ".join(keys)
    return _add(joined, [F.when(later, f"{name}: duplicate key")]).drop(
        "_first", *[f"_key_{k}" for k in keys]
    )


def flag_rows(
    df: DataFrame,
    spec: TableSpec,
    parents: dict[str, DataFrame],
    order_cols: OrderCols | None = None,
) -> DataFrame:
    """All row checks of a table. Duplicate keys are tested where an order is given.

    ``df`` is read up to three times, twice only for its keys: pass a stored table.
    """
    flagged = _add(df, [*domain_reasons(df, spec), *not_null_reasons(spec)])
    flagged = flag_orphans(flagged, spec, parents)
    if order_cols is not None:
        flagged = flag_duplicates(flagged, list(spec.conflict_key), order_cols)
        if spec.serial in df.columns and spec.serial not in spec.conflict_key:
            flagged = flag_duplicates(flagged, [spec.serial], order_cols)
    return flagged


def split_valid(
    df: DataFrame,
    spec: TableSpec,
    parents: dict[str, DataFrame],
    order_cols: OrderCols,
) -> tuple[DataFrame, DataFrame]:
    """Row by row: bad rows are set aside with their reasons, the others load."""
    return split(flag_rows(df, spec, parents, order_cols))


def split_valid_batches(
    df: DataFrame,
    batch_key: str,
    spec: TableSpec,
    parents: dict[str, DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Batch by batch: one bad row sets its whole batch aside.

    The bad batch keys are collected by a distinct, so a hot batch is never gathered
    in one task. Duplicate keys are no error on this path.
    """
    flagged = flag_rows(df, spec, parents)
    bad = broadcast_if_small(
        pin(flagged.filter(~is_good()).select(F.col(batch_key).alias("_bad")).distinct())
    )
    same = F.col(batch_key).eqNullSafe(F.col("_bad"))
    good = flagged.join(bad, same, "left_anti").drop(REASONS)
    return good, flagged.join(bad, same, "left_semi")


def load_report(flagged: dict[str, DataFrame]) -> DataFrame:
    """Rows inserted, rows seen and rows in error per table."""
    tables = [
        df.agg(
            F.count_if(is_good()).alias("inserted"),
            F.count("*").alias("total"),
            F.count_if(~is_good()).alias("errors"),
        ).select(F.lit(name).alias("table_name"), "inserted", "total", "errors")
        for name, df in flagged.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def reject_samples(
    flagged: dict[str, DataFrame], order_cols: OrderCols, n: int = 3
) -> DataFrame:
    """The first ``n`` rejected rows of each table, as JSON with their reasons."""

    def sample(name: str, df: DataFrame) -> DataFrame:
        # A plain limit after a sort: TakeOrdered keeps n rows per task.
        values = [c for c in df.columns if c != REASONS]
        first = df.filter(~is_good()).orderBy(*order_cols).limit(n)
        numbered = first.withColumn(
            "error_number", F.row_number().over(Window.orderBy(*order_cols))
        )
        return numbered.select(
            F.lit(name).alias("table_name"),
            "error_number",
            F.array_join(REASONS, "; ").alias("reasons"),
            F.to_json(F.struct(*values)).alias("row_values"),
        )

    return reduce(DataFrame.unionByName, [sample(n_, d) for n_, d in flagged.items()])
