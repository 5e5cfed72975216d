"""Balanced label propagation: linked documents share a shard as far as quotas allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import numbered, salted_join, stored

_CELLS = 4096
# Groups above this size are numbered in 256 parts each.
_LARGE_GROUP = 100_000


def _uniform(*columns: str | Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _per_shard(df: DataFrame, column: str, shards: int) -> list[int]:
    """Rows per value of ``column``; ``shards`` numbers, so small at any size."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count().collect()
    found = {row[0]: row[1] for row in counts}
    return [found.get(s, 0) for s in range(shards)]


def _lookup(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard + 1)


def _propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Labels of linked rows (``_link``, ``_tie``, ``shard``) after at most ``rounds`` rounds.

    Each round every row votes for its shard among the rows of its link, and wants to go
    where most votes are (ties by a hash of link and shard, alike for all rows of a link).
    A shard that is full takes nobody; one with less room than demand takes each applicant
    with the same probability, drawn from a hash.
    """
    for turn in range(rounds):
        held = _per_shard(linked, "shard", shards)
        votes = (
            linked.groupBy("_link", "shard")
            .agg(F.count("*").alias("n"))
            .groupBy("_link")
            .agg(
                F.array(
                    *[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)) for s in range(shards)]
                ).alias("_votes")
            )
        )
        joined = salted_join(linked.drop("_total"), votes, ["_link"], ["_tie"])
        ranked = F.array(
            *[
                F.when(
                    F.lit(held[s] < quota) | (F.col("shard") == s),
                    F.struct(
                        F.col("_votes")[s].alias("votes"),
                        F.xxhash64("_link", F.lit(s)).alias("tie"),
                        F.lit(s).alias("shard"),
                    ),
                )
                for s in range(shards)
            ]
        )
        wishes = stored(
            joined.select(
                *[c for c in linked.columns if c != "_total"],
                F.aggregate("_votes", F.lit(0).cast("long"), lambda a, v: a + v).alias("_total"),
                F.array_max(ranked)["shard"].alias("_wish"),
            ),
            "shard-round",
        )
        demand = _per_shard(wishes.where("_wish <> shard"), "_wish", shards)
        linked = wishes
        if any(demand):
            share = [
                min(1.0, max(0, quota - h) / d) if d else 0.0
                for h, d in zip(held, demand, strict=True)
            ]
            goes = _uniform("_tie", F.lit(turn)) < _lookup(share, F.col("_wish"))
            linked = wishes.withColumn("shard", F.when(goes, F.col("_wish")).otherwise(F.col("shard")))
        linked = linked.drop("_wish")
        if not any(demand):
            break
    return linked


def balanced_shards(docs: DataFrame, link: str, shards: int = 8, rounds: int = 8) -> DataFrame:
    """Deal rows to ``shards`` shards whose counts differ by one at most.

    Rows with an equal value of ``link`` are linked. All columns of ``docs`` are returned,
    then ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Linked rows start at random and move by :func:`_propagate`, so a link is cut only where
    it alone exceeds the room left. At the end each shard keeps linked rows up to its exact
    quota, whole links first; the rest and all rows without partners fill what is free.

    Rows whose ``link`` is null have no partners; repeated rows count one by one. An empty
    table gives no rows. Columns named ``shard`` or ``slot`` are replaced.

    Everything that comes to the driver has ``shards`` rows. Votes are combined before each
    shuffle; the rows of a common link are dealt over several tasks (:func:`salted_join`).
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_whole")
    rows = docs.select(whole, F.col(f"`{link}`").alias("_link"))
    partners = rows.where("_link IS NOT NULL").groupBy("_link").agg(F.count("*").alias("_n"))
    tied = rows.withColumn("_tie", F.xxhash64("_whole"))
    marked = stored(
        salted_join(tied, partners.where("_n > 1"), ["_link"], ["_tie"], "left"), "shard-rows"
    )
    total = marked.count()
    exact = [total // shards + (s < total % shards) for s in range(shards)]
    first = F.pmod(F.xxhash64("_tie", F.lit("first")), F.lit(shards)).cast("int")
    linked = _propagate(
        marked.where("_n IS NOT NULL").drop("_n").withColumn("shard", first).withColumn(
            "_total", F.lit(0).cast("long")
        ),
        shards,
        total // shards,
        rounds,
    )
    cell = F.pmod(F.xxhash64("_link"), F.lit(_CELLS)).cast("int")
    part = F.when(F.col("_total") > _LARGE_GROUP, 1 + F.pmod(F.col("_tie"), F.lit(256))).otherwise(0)
    placed = stored(
        numbered(
            linked.withColumn("_cell", cell).withColumn("_part", part.cast("int")),
            "shard",
            ["_cell", "_part"],
            ["_link", "_tie"],
            "slot",
        ),
        "shard-linked",
    )
    held = _per_shard(placed, "shard", shards)
    kept = [min(h, e) for h, e in zip(held, exact, strict=True)]
    stays = F.col("slot") < _lookup(exact, F.col("shard"))
    pool = (
        marked.where("_n IS NULL")
        .select("_whole", "_tie", F.lit(None).cast("string").alias("_near"))
        .unionByName(
            placed.where(~stays).select("_whole", "_tie", F.col("_link").cast("string").alias("_near"))
        )
        .withColumn("_cell", F.pmod(F.xxhash64("_near", F.when(F.col("_near").isNull(), F.col("_tie"))), F.lit(_CELLS)).cast("int"))
        .withColumn("_part", F.when(F.col("_near").isNull(), 0).otherwise(F.pmod(F.col("_tie"), F.lit(256))).cast("int"))
        .withColumn("_all", F.lit(0))
    )
    ranked = numbered(pool, "_all", ["_cell", "_part"], ["_tie"], "_place")
    begins, at = [], 0
    for e, k in zip(exact, kept, strict=True):
        begins.append(at)
        at += e - k
    shard = F.lit(0)
    for s in range(1, shards):
        shard = F.when(F.col("_place") >= begins[s], F.lit(s)).otherwise(shard)
    filled = ranked.withColumn("shard", shard).withColumn(
        "slot",
        F.col("_place") - _lookup(begins, F.col("shard")) + _lookup(kept, F.col("shard")),
    )
    result = ["_whole.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")]
    return placed.where(stays).select(*result).unionByName(filled.select(*result))
