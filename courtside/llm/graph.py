"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored


def components(links: DataFrame, name: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for all nodes of ``links`` (a, b).

    Rounds of two steps until nothing changes: every node takes the smallest root among
    its neighbours, then the root of its root. Long chains so need few rounds. Roots that
    many nodes share are looked up over several tasks; only the number of changes comes to
    the driver.
    """
    both = stored(
        links.where("a <> b")
        .select("a", "b")
        .unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        f"{name}-edges",
    )
    state = stored(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"),
        f"{name}-start",
    )
    while True:
        heard = (
            salted_join(both, state.withColumnRenamed("node", "a"), ["a"], ["b"])
            .groupBy("b")
            .agg(F.min("root").alias("_near"))
            .withColumnRenamed("b", "node")
        )
        nearer = state.join(heard, "node").select(
            "node", F.col("root").alias("_old"), F.least("root", "_near").alias("root")
        )
        pointers = state.select(F.col("node").alias("root"), F.col("root").alias("_further"))
        state = stored(
            salted_join(nearer, pointers, ["root"], ["node"], "left").select(
                "node", "_old", F.least("root", F.coalesce("_further", "root")).alias("root")
            ),
            f"{name}-round",
        )
        changed = state.where("_old <> root").limit(1).count()
        state = state.drop("_old")
        if not changed:
            return state
