"""Keys and write semantics: first-row dedupe, insert-ignore, upsert, row ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.session import broadcast_if_small, pin

OrderCols = Sequence[Column | str]


def null_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _descending(order_cols: OrderCols) -> list[Column]:
    return [F.desc(c) if isinstance(c, str) else c.desc() for c in order_cols]


def _one_per_key(df: DataFrame, keys: Sequence[str], order: OrderCols) -> DataFrame:
    # row_number() = 1 plans as WindowGroupLimit: each map task keeps one row per
    # key before the shuffle, so a hot key sends one row per task, not all its rows.
    ranked = df.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def dedupe_first(df: DataFrame, keys: Sequence[str], order_cols: OrderCols) -> DataFrame:
    """Keep the first row to arrive for each key."""
    return _one_per_key(df, keys, order_cols)


def dedupe_last(df: DataFrame, keys: Sequence[str], order_cols: OrderCols) -> DataFrame:
    """Keep the last row to arrive for each key."""
    return _one_per_key(df, keys, _descending(order_cols))


def fresh_rows(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_cols: OrderCols,
    nullable_keys: bool = False,
    narrow_by: str | None = None,
) -> DataFrame:
    """The batch rows an insert-ignore adds: first arrivals of keys not yet stored.

    Only the target's key columns take part in the join. ``narrow_by`` names a key
    column with few distinct values in the batch (a season's games, say): stored keys
    are then cut down to those values where they are read, before any shuffle. With
    ``nullable_keys`` rows whose key holds a NULL never conflict.
    """
    keyed = batch.dropna(subset=list(keys)) if nullable_keys else batch
    stored = target.select(*keys)
    if narrow_by is not None:
        touched = broadcast_if_small(pin(keyed.select(narrow_by).distinct()))
        stored = stored.join(touched, narrow_by, "left_semi")
    fresh = dedupe_first(keyed, keys, order_cols).join(stored, list(keys), "left_anti")
    if nullable_keys:
        fresh = fresh.unionByName(batch.filter(null_key(keys)))
    return fresh


def insert_ignore(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_cols: OrderCols,
    nullable_keys: bool = False,
    narrow_by: str | None = None,
) -> DataFrame:
    """``ON CONFLICT DO NOTHING``: stored rows win, then the first arrival.

    The target's full rows are passed through unshuffled; see ``fresh_rows``.
    """
    fresh = fresh_rows(target, batch, keys, order_cols, nullable_keys, narrow_by)
    return target.unionByName(fresh.select(*target.columns))


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_cols: OrderCols,
    keep: Sequence[str] = ("id",),
    nullable_keys: bool = True,
) -> DataFrame:
    """``ON CONFLICT DO UPDATE``: the batch replaces every column but key and ``keep``.

    A key repeated in the batch takes its last row (``batch_conflicts`` counts them).
    Both sides of the outer join hold one row per key, so no key is hot. Rows with a
    NULL in the key match nothing and are all kept, as UNIQUE has it; pass
    ``nullable_keys=False`` to save that second read of a batch known to have none.
    """
    keyed = batch.dropna(subset=list(keys))
    new = dedupe_last(keyed, keys, order_cols).withColumn("_new", F.lit(True))
    t, b = target.alias("t"), new.alias("b")
    matched = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")

    def column(name: str) -> Column:
        old = F.col(f"t.{name}")
        if name not in new.columns:
            return old.alias(name)
        if name in keep:
            return F.coalesce(old, F.col(f"b.{name}")).alias(name)
        return F.when(F.col("b._new"), F.col(f"b.{name}")).otherwise(old).alias(name)

    merged = matched.select(*[column(c) for c in target.columns])
    if nullable_keys:
        unkeyed = batch.filter(null_key(keys))
        present = [c for c in target.columns if c in batch.columns]
        merged = merged.unionByName(unkeyed.select(*present), allowMissingColumns=True)
    return merged


def batch_conflicts(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in a batch, and how many rows lose."""
    repeated = (
        batch.dropna(subset=list(keys)).groupBy(*keys).count().filter(F.col("count") > 1)
    )
    return repeated.agg(
        F.count("*").alias("repeated_keys"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows_replaced"),
    )


def hash_order(keys: Sequence[str], seed: str = "") -> Column:
    """A reproducible pseudo-random sort key (md5 text, the same in any engine)."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def bucket_offsets(df: DataFrame, bucket: str) -> DataFrame:
    """Rows per bucket, rows in earlier buckets, and the total: one row per bucket.

    The running sum is over buckets, whose number the caller fixes, not over rows.
    """
    counts = df.groupBy(bucket).agg(F.count("*").alias("_size"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return counts.select(
        bucket,
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(everything).alias("_total"),
    )


def with_surrogate_id(
    df: DataFrame, keys: Sequence[str], name: str = "id", hex_digits: int = 4
) -> DataFrame:
    """Unique row ids 1..n in hash order of a unique business key.

    Rows are numbered inside ``16 ** hex_digits`` hash buckets and shifted by the
    bucket's offset, so no task sees more than one bucket and reruns give the same
    ids. The offsets table has at most one row per bucket.
    """
    hashed = df.withColumn("_hash", hash_order(keys))
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, hex_digits))
    offsets = bucket_offsets(bucketed, "_bucket").select("_bucket", "_before")
    within = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    return (
        bucketed.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
        .drop("_hash", "_bucket", "_rn", "_before")
    )


def allocate_ids(
    rows: DataFrame, keys: Sequence[str], above: int = 0, name: str = "id"
) -> DataFrame:
    """Row ids ``above + 1, above + 2, ...`` in hash order of ``keys`` (see above).

    ``rows`` must be pinned: they are read twice. Rows with equal keys get ids of their own.
    """
    numbered = with_surrogate_id(rows, keys, name)
    return numbered.withColumn(name, F.col(name) + F.lit(above).cast("bigint"))
