import time

import pytest

from courtside.catalogue.evaluation import GOLD_STATEMENTS
from courtside.plans.ask import ask
from courtside.plans.evaluation import evaluate
from courtside.plans.statements import (
    TIMEOUT,
    _beside_one_row,
    ordered_rows,
    run_sql,
    run_statements,
    unknown_qualifier,
)
from courtside.session import without_nulls


@pytest.fixture(scope="module")
def table(spark):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string").createOrReplaceTempView(
        "things"
    )
    yield "things"
    spark.catalog.dropTempView("things")


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW things",
        "CREATE TABLE made (a int)",
        "SET spark.sql.shuffle.partitions=3",
        "INSERT INTO things VALUES (3, 'c')",
        "WITH q AS (SELECT 1) INSERT INTO things SELECT 3, 'c'",
        "FROM things INSERT INTO things SELECT *",
        "SELECT 1) t; DROP VIEW things; SELECT * FROM (SELECT 2",
    ],
)
def test_only_queries_run(spark, table, sql):
    assert not run_sql(spark, sql).ok
    assert spark.table("things").count() == 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


@pytest.mark.parametrize(
    "sql", ["SELECT * FROM things;", "WITH q AS (SELECT 1 AS a) SELECT a FROM q", " select 1 -- x"]
)
def test_queries_are_accepted(spark, table, sql):
    assert run_sql(spark, sql).df.count() >= 1


def test_order_survives(spark, table):
    outcome = run_sql(spark, "SELECT k FROM things ORDER BY k DESC;")
    assert [r.k for r in outcome.df.collect()] == [2, 1, 1]


def test_statements_and_their_failures(spark, table):
    texts = [
        "SELECT k, k FROM things",
        "SELECT CAST(v AS int) FROM things",
        "SELECT nope FROM things",
        "SELECT z.k FROM things t",
        "SELECT v FROM things WHERE k = 9",
    ]
    rows, outcomes = run_statements(spark, list(enumerate(texts)), chunk=2)
    by_id = {r.statement_id: r for r in outcomes.collect()}
    assert [by_id[i].ok for i in range(5)] == [True, False, False, False, True]
    assert by_id[0].columns == ["k", "k"]
    assert by_id[1].condition == "CAST_INVALID_INPUT"
    assert by_id[3].unknown_qualifier and not by_id[2].unknown_qualifier
    assert sorted(r.row for r in rows.collect()) == [["1", "1"], ["1", "1"], ["2", "2"]]


def test_unknown_qualifier():
    message = "name `z`.`k` cannot be resolved"
    condition = "UNRESOLVED_COLUMN.WITH_SUGGESTION"
    assert unknown_qualifier("SELECT z.k FROM t", condition, message)
    assert not unknown_qualifier("SELECT z.k FROM t AS z", condition, message)
    assert not unknown_qualifier("SELECT z.k FROM t JOIN z ON 1", condition, message)
    assert not unknown_qualifier("SELECT z.k FROM t", "OTHER", message)


def test_evaluation_of_every_kind_of_prediction(spark, folder):
    import __spark_entry__ as driver

    rows = driver.queries()["evaluate_statements"](spark, folder).collect()
    got = {(r.gold_name, r.kind): r for r in rows}
    for name in GOLD_STATEMENTS:
        assert got[name, "identical"].correct == 1 and got[name, "identical"].dist == 0
        assert got[name, "reordered"].correct == 1
        for kind, label in {
            "unknown_table": "missing_table",
            "unknown_column": "missing_column",
            "syntax_error": "syntax_error",
            "missing_group_by": "group_by_error",
            "runtime_error": "type_mismatch",
        }.items():
            assert (got[name, kind].correct, got[name, kind].error_class) == (0, label)
    # Two empty results are equal whatever their width.
    assert got["nobody", "extra_column"].correct == 1
    assert got["club_bests", "extra_column"].correct == 0
    assert got["from_college", "null_as_blank"].correct == 1
    assert got["from_college", "distinct"].correct == 0
    assert all(got[name, "command"].correct == 0 for name in GOLD_STATEMENTS)
    assert not got["broken_gold", "identical"].gold_ok


def test_ask(spark, table):
    answer = ask(spark, "SELECT k FROM things ORDER BY k", "SELECT k FROM things;", max_rows=2)
    assert (answer.ok, answer.columns, len(answer.rows), answer.more) == (True, ["k"], 2, True)
    assert answer.scores.correct == 1 and answer.scores.dist == 3
    failed = ask(spark, "SELECT CAST(v AS int) FROM things")
    assert not failed.ok and "CAST_INVALID_INPUT" in failed.error


def test_null_statements_are_failures(spark, table):
    rows = [
        ("SELECT k FROM things", None),
        (None, "SELECT k FROM things"),
        (None, None),
        ("SELECT k FROM things", "SELECT k FROM things"),
    ]
    examples = spark.createDataFrame(
        [(i, g, p) for i, (g, p) in enumerate(rows)], "i int, gold_sql string, pred_sql string"
    )
    got = {r.i: r for r in evaluate(spark, examples).collect()}
    assert [got[i].gold_ok for i in range(4)] == [True, False, False, True]
    assert [got[i].correct for i in range(4)] == [0, 0, 0, 1]
    assert got[0].pred_err and got[0].dist == 4 and got[3].dist == 0


SLOW = "SELECT sum((r.id * t.n) % 7) AS s FROM range(100000000000000) r CROSS JOIN (SELECT count(*) AS n FROM things) t"


def test_a_slow_statement_fails_alone(spark, table):
    """A slow and a failing statement beside two good ones, in one chunk and in several."""
    texts = ["SELECT k FROM things", SLOW, "SELECT CAST(v AS int) FROM things", "SELECT v FROM things"]
    for chunk in (4, 2):
        begun = time.monotonic()
        rows, outcomes = run_statements(spark, list(enumerate(texts)), chunk=chunk, seconds=8)
        assert time.monotonic() - begun < 60
        by_id = {r.statement_id: r for r in outcomes.collect()}
        assert [by_id[i].ok for i in range(4)] == [True, False, False, True]
        assert by_id[1].condition == TIMEOUT and by_id[2].condition == "CAST_INVALID_INPUT"
        assert sorted((r.statement_id, *r.row) for r in rows.collect()) == [
            (0, "1"), (0, "1"), (0, "2"), (3, ""), (3, "a"), (3, "a"),
        ]
    # No job of a stopped statement goes on, and other jobs have no limit.
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert not spark.sparkContext.getJobTags()


def test_chunks_run_side_by_side_and_keep_their_outcomes(spark, table):
    texts = [
        "SELECT k FROM things WHERE k = %d" % (i % 3) if i % 5 else f"SELECT no_{i} FROM things"
        for i in range(47)
    ]
    for at_once in (1, 3):
        rows, outcomes = run_statements(spark, list(enumerate(texts)), chunk=4, at_once=at_once)
        found = {r.statement_id: r.ok for r in outcomes.collect()}
        assert found == {i: bool(i % 5) for i in range(47)}
        assert rows.count() == sum({0: 0, 1: 2, 2: 1}[i % 3] for i in range(47) if i % 5)


def test_no_statements(spark):
    rows, outcomes = run_statements(spark, [])
    assert rows.count() == 0 and outcomes.count() == 0


def test_ordered_evaluation(spark, table):
    spark.range(0, 5000, numPartitions=7).createOrReplaceTempView("numbers")
    gold = "SELECT id, id % 10 AS d FROM numbers ORDER BY d, id"
    pairs = {
        "same": (gold, "SELECT id, d FROM (SELECT id, id % 10 AS d FROM numbers) ORDER BY d, id"),
        "turned": (gold, "SELECT id, id % 10 AS d FROM numbers ORDER BY d DESC, id"),
        "swapped": (gold, "SELECT id, d FROM (SELECT id, id % 10 AS d FROM numbers) "
                    "ORDER BY d, CASE id WHEN 8 THEN 18 WHEN 18 THEN 8 ELSE id END"),
        "shorter": (gold, gold + " LIMIT 4999"),
        "other_type": (gold, "SELECT CAST(id AS decimal(20,3)), CAST(id % 10 AS double) AS d FROM numbers ORDER BY d, id"),
        "null_is_not_blank": ("SELECT v FROM things ORDER BY v, k", "SELECT coalesce(v, '') AS v FROM things ORDER BY v, k"),
        "blanks_count": ("SELECT 'a' AS v", "SELECT 'a ' AS v"),
        "both_empty": ("SELECT k FROM things WHERE k > 5 ORDER BY k", "SELECT v FROM things WHERE k > 6 ORDER BY k"),
    }
    examples = spark.createDataFrame(
        [(n, g, p) for n, (g, p) in pairs.items()], "name string, gold_sql string, pred_sql string"
    )
    got = {r.name: r.correct for r in evaluate(spark, examples, ordered=True).collect()}
    assert got == {n: int(n in ("same", "other_type", "both_empty")) for n in pairs}
    bags = {r.name: r.correct for r in evaluate(spark, examples).collect()}
    assert [bags[n] for n in ("turned", "swapped", "null_is_not_blank", "blanks_count")] == [1, 1, 1, 1]
    spark.catalog.dropTempView("numbers")


NOT_IN = "SELECT k FROM many WHERE k NOT IN (SELECT k FROM some WHERE v = 'x')"


def _broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_not_in_between_full_columns_is_no_broadcast(spark, tmp_path):
    """The rows of the subquery go to the driver only if a NULL may be among them."""
    spark.range(100).selectExpr("CAST(id AS int) AS k").write.parquet(f"{tmp_path}/many")
    rows = [(1, "x"), (1, "x"), (2, "y"), (3, "x")]
    spark.createDataFrame(rows, "k int, v string").write.parquet(f"{tmp_path}/full")
    spark.createDataFrame([*rows, (None, "x")], "k int, v string").write.parquet(f"{tmp_path}/gaps")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        without_nulls(spark.read.parquet(f"{tmp_path}/many"), ["k"]).createOrReplaceTempView("many")
        for name, left in (("full", 98), ("gaps", 0)):
            some = without_nulls(spark.read.parquet(f"{tmp_path}/{name}"), ["k", "v"])
            some.createOrReplaceTempView("some")
            planned = _beside_one_row(spark, run_sql(spark, NOT_IN).df)
            assert _broadcasts(planned) == (name == "gaps")
            got, outcomes = run_statements(spark, [(0, NOT_IN)])
            assert (got.count(), outcomes.first().ok) == (left, True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        for name in ("many", "some"):
            spark.catalog.dropTempView(name)


def test_only_columns_without_nulls_are_known_to_have_none(spark):
    made = spark.createDataFrame([(1, None, "a", 0.5), (0, 2, "", None)], "a int, b int, c string, d double")
    known = without_nulls(made, ["a", "b", "c", "nothing"])
    assert [f.nullable for f in known.schema] == [False, True, False, True]
    assert known.schema.simpleString() == made.schema.simpleString()
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, made.collect()))


def test_order_and_chance_with_not_in(spark):
    """Rows keep their places, and a result may hang on chance."""
    texts = [
        "SELECT id FROM range(0, 5000, 1, 7) WHERE id NOT IN (9, 5000) ORDER BY id DESC",
        "SELECT count(*) AS n FROM (SELECT rand() AS r FROM range(10)) WHERE r NOT IN (2, 3)",
        "SELECT rand() < 2 AS sure FROM range(3) WHERE NOT id IN (SELECT 4)",
    ]
    rows, outcomes = run_statements(spark, list(enumerate(texts)), shape=ordered_rows)
    assert all(r.ok for r in outcomes.collect())
    in_order = rows.where("statement_id = 0").orderBy("pos").collect()
    assert [int(r.row[0]) for r in in_order] == [i for i in range(4999, -1, -1) if i != 9]
    assert [r.row for r in rows.where("statement_id = 1").collect()] == [["10"]]
    assert [r.row for r in rows.where("statement_id = 2").collect()] == [["true"]] * 3
    bags, _ = run_statements(spark, list(enumerate(texts)))
    assert bags.where("statement_id = 0").count() == 4999
    others = sorted(r.row for r in bags.where("statement_id > 0").collect())
    assert others == [["10"], *[["true"]] * 3]
