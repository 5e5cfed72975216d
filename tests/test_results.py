import random
from collections import Counter

import pytest

from courtside.operators import results
from courtside.session import pin

LONG = "example_id bigint, side string, pos int, row array<string>"


def python_rows(rng):
    return [[rng.choice("ab"), rng.choice(["", "1"])] for _ in range(rng.randint(0, 3))]


def test_bag_and_ordered_against_python(spark):
    rng = random.Random(7)
    pairs = [(python_rows(rng), python_rows(rng)) for _ in range(200)]
    long = [
        (i, side, p, row)
        for i, pair in enumerate(pairs)
        for side, rows in zip(("gold", "pred"), pair)
        for p, row in enumerate(rows)
    ]
    df = spark.createDataFrame(long, LONG)
    examples = spark.range(len(pairs)).withColumnRenamed("id", "example_id")
    bag = {r.example_id: r.correct for r in results.compare_results(df, examples).collect()}
    ordered = {r.example_id: r.correct for r in results.compare_ordered(df, examples).collect()}
    for i, (gold, pred) in enumerate(pairs):
        assert bag[i] == int(Counter(map(tuple, gold)) == Counter(map(tuple, pred)))
        assert ordered[i] == int(gold == pred)


def test_normalise_rows(spark):
    df = spark.createDataFrame([(1, " a ", None, 2.0)], "k int, s string, n string, d double")
    row = results.normalise_rows(df, keep=["k"]).first()
    assert (row.k, row.row) == (1, ["a", "", "2.0"])


def test_with_positions(spark):
    df = pin(spark.range(500).orderBy("id", ascending=False).repartitionByRange(7, "id"))
    rows = results.with_positions(pin(df.sort("id"))).collect()
    assert sorted((r.pos, r.id) for r in rows) == [(i + 1, i) for i in range(500)]


@pytest.mark.parametrize(("n", "limit"), [(0, 3), (2, 3), (3, 3), (9, 3)])
def test_result_preview(spark, n, limit):
    data = [(1, p, [str(p), None if p == 1 else "x"]) for p in range(n)]
    df = spark.createDataFrame(data, "example_id int, pos int, row array<string>")
    headers = spark.createDataFrame(
        [(1, ["a", "b"]), (2, [])], "example_id int, header array<string>"
    )
    got = {
        r.example_id: r.preview for r in results.result_preview(df, headers, limit).collect()
    }
    lines = ["a | b", "-" * 20]
    lines += [f"{p} | {'' if p == 1 else 'x'}" for p in range(min(n, limit))]
    if n > limit:
        lines.append(f"... ({n - limit} rows not shown)")
    assert got == {1: "\n".join([*lines, ""]), 2: "(no rows returned)"}


def test_positions_do_not_shuffle_the_rows(spark):
    df = pin(spark.range(100).repartition(5).sort("id"))
    numbered = results.with_positions(df)
    assert "Exchange hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [r.pos for r in numbered.sort("id").collect()] == list(range(1, 101))


def test_sums_tell_results_apart_without_order_or_with(spark):
    rows = [(1, 1, ["a"]), (1, 2, ["b"]), (2, 1, ["b"]), (2, 2, ["a"]), (3, 1, ["a"]), (4, 1, ["a"]), (4, 2, ["a"])]
    frame = spark.createDataFrame(rows, "statement_id long, pos long, row array<string>")
    bags = {r.statement_id: r.sums for r in results.sums_of(frame, "statement_id").collect()}
    lists = {r.statement_id: r.sums for r in results.sums_of(frame, "statement_id", True).collect()}
    assert bags[1] == bags[2] and len(set(bags.values())) == 3
    assert len(set(lists.values())) == 4
