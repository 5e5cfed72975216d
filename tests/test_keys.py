import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import keys as k
from courtside.operators.aggregates import rank_values, season_ranks
from courtside.operators.corpus import split_corpus
from courtside.session import broadcast_if_small, pin

SCHEMA = "id bigint, a int, b int, v string, o int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_dedupe_first_and_last(spark):
    df = frame(spark, [(1, 1, 1, "x", 2), (2, 1, 1, "y", 1), (3, 1, 2, "z", 3)])
    first = {(r.a, r.b): r.v for r in k.dedupe_first(df, ["a", "b"], ["o"]).collect()}
    last = {(r.a, r.b): r.v for r in k.dedupe_last(df, ["a", "b"], ["o"]).collect()}
    assert first == {(1, 1): "y", (1, 2): "z"}
    assert last == {(1, 1): "x", (1, 2): "z"}


@pytest.mark.parametrize("narrow_by", [None, "a"])
def test_insert_ignore(spark, narrow_by):
    target = frame(spark, [(1, 1, 1, "old", 0), (2, 9, 9, "far", 0)])
    batch = frame(
        spark,
        [(0, 1, 1, "new", 1), (0, 2, 2, "late", 2), (0, 2, 2, "early", 1), (0, 1, 2, "n", 1)],
    )
    rows = k.insert_ignore(target, batch, ["a", "b"], ["o"], narrow_by=narrow_by).collect()
    assert {(r.a, r.b): r.v for r in rows} == {
        (1, 1): "old", (9, 9): "far", (2, 2): "early", (1, 2): "n",
    }


def test_insert_ignore_null_keys_never_conflict(spark):
    target = frame(spark, [(1, None, 1, "old", 0)])
    batch = frame(spark, [(0, None, 1, "x", 1), (0, None, 1, "y", 2), (0, 3, 3, "z", 1)])
    rows = k.insert_ignore(target, batch, ["a", "b"], ["o"], nullable_keys=True).collect()
    assert sorted(r.v for r in rows) == ["old", "x", "y", "z"]


def test_upsert_replaces_all_but_key_and_id(spark):
    target = frame(spark, [(7, 1, 1, "old", 0), (8, 2, 2, "stays", 0), (9, 3, None, "n", 0)])
    batch = frame(
        spark,
        [(0, 1, 1, "first", 1), (0, 1, 1, None, 2), (50, 4, 4, "new", 1), (0, 3, None, "m", 1)],
    )
    rows = k.upsert(target, batch, ["a", "b"], ["o"]).collect()
    got = sorted(((r.id, r.a, r.b, r.v) for r in rows), key=str)
    # The last batch row wins even where it is NULL; NULL keys match nothing.
    want = [(7, 1, 1, None), (8, 2, 2, "stays"), (9, 3, None, "n"), (50, 4, 4, "new")]
    assert got == sorted([*want, (0, 3, None, "m")], key=str)
    lost = k.batch_conflicts(batch, ["a", "b"]).first()
    assert (lost.repeated_keys, lost.rows_replaced) == (1, 1)


def test_surrogate_ids_are_dense_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    first = {r.a: r.id for r in k.with_surrogate_id(df, ["a", "b"]).collect()}
    again = {
        r.a: r.id for r in k.with_surrogate_id(df.repartition(3), ["a", "b"]).collect()
    }
    assert first == again and sorted(first.values()) == list(range(1, 1001))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 7, 10, 15, 99, 1000])
@pytest.mark.parametrize("digits", [1, 4])
def test_split_sizes_are_exact(spark, n, digits):
    counts = {
        r.split: r["count"]
        for r in split_corpus(spark.range(n), "id", hex_digits=digits)
        .groupBy("split")
        .count()
        .collect()
    }
    held_out = -(-n // 5)
    test = -(-held_out // 2)
    assert counts.get("test", 0) == test
    assert counts.get("val", 0) == held_out - test
    assert counts.get("train", 0) == n - held_out


def test_split_depends_on_the_seed_only(spark):
    def tested(seed, parts):
        df = split_corpus(spark.range(0, 200, 1, parts), "id", seed=seed)
        return {r.id for r in df.filter("split = 'test'").collect()}

    assert tested(20, 1) == tested(20, 5) != tested(21, 1)


def test_rank_values_against_sorting(spark):
    rng = random.Random(3)
    pool = [None, 0.0, -0.0, 1.0, -1.5, 1e6, 1e6 + 1, -2e5, 0.25, 3.0]
    values = [(rng.choice("ab"), rng.choice([*pool, rng.uniform(-9, 9)])) for _ in range(400)]
    df = spark.createDataFrame(values, "g string, v double")
    for descending in (True, False):
        rows = rank_values(df, ["g"], "v", F.lit(descending)).collect()
        for r in rows:
            same = [v for g, v in values if g == r.g]
            # PostgreSQL: NULLs first when descending, last when ascending.
            if r.v is None:
                before = 0 if descending else sum(v is not None for v in same)
            elif descending:
                before = sum(v is None or v > r.v for v in same)
            else:
                before = sum(v is not None and v < r.v for v in same)
            assert r["rank"] == before + 1


def test_season_ranks_direction(spark):
    df = spark.createDataFrame(
        [(1, 1, 5.0, 2.0), (2, 1, 7.0, 1.0), (3, 1, 7.0, 9.0), (1, 2, 1.0, 1.0)],
        "player_id int, season_id int, pts double, tov double",
    )
    rows = season_ranks(df, ["pts", "tov"], ascending=["tov"]).collect()
    got = {(r.player_id, r.season_id): (r.pts_rank, r.tov_rank) for r in rows}
    assert got == {(1, 1): (3, 2), (2, 1): (1, 1), (3, 1): (1, 3), (1, 2): (1, 1)}


def test_broadcast_only_under_the_limit(spark):
    pinned = pin(spark.range(20))
    small = broadcast_if_small(pinned, 20)._jdf.queryExecution().logical().toString()
    large = broadcast_if_small(pinned, 19)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small and "broadcast" not in large
