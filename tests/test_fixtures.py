"""The views over the driver's tables: same rows as before, fewer and smaller steps."""

import datetime as dt

import pytest
from courtside.catalogue import QUERIES, load
from courtside.fixtures import PGTT, Views

load()

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
)
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderstatus string"


@pytest.fixture
def never_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, value in before.items():
        spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder, order_keys, lines):
    day = dt.datetime(1998, 5, 4)
    orders = [(k, 1, day, "F") for k in order_keys]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{folder}/orders.parquet")
    rows = [(o, p, 1, n, float(q), 1.0, 0.02, 0.03, day) for o, p, n, q in lines]
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    suppliers = spark.createDataFrame([(1, 7)], "s_suppkey bigint, s_nationkey int")
    suppliers.write.parquet(f"{folder}/supplier.parquet")
    return Views(spark, str(folder))


@pytest.mark.usefixtures("never_broadcast")
def test_the_log_is_not_shuffled_after_its_joins(spark, folder):
    text = plan(Views(spark, folder)["player_game_log"])
    assert text.count("Exchange hashpartitioning") == 4
    assert "hashpartitioning(player_id" not in text


def test_one_log_per_player_and_game(spark, tmp_path):
    lines = [(1, 5, 2, 20), (1, 5, 1, 10), (1, None, 1, 30), (1, None, 2, 31), (2, 5, 1, 40)]
    found = tables(spark, tmp_path / "x", [1, 2, 3], lines)["player_game_log"].collect()
    want = [("0000000001", 5, 10.0), ("0000000001", None, 30.0), ("0000000002", 5, 40.0)]
    assert sorted((r.game_id, r.player_id or 9, r.pts) for r in found) == [
        (g, p or 9, n) for g, p, n in want
    ]


def test_orders_that_share_a_cut_game_id_count_as_one_game(spark, tmp_path):
    keys = [12345678901, 12345678902]
    lines = [(keys[0], 5, 2, 20), (keys[1], 5, 1, 10)]
    found = tables(spark, tmp_path / "x", keys, lines)["player_game_log"].collect()
    assert [(r.game_id, r.pts) for r in found] == [("1234567890", 10.0)]


def test_many_splits_get_more_tasks_than_the_session_has(spark, folder):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        log = Views(spark, folder)["player_game_log"]
        assert "hashpartitioning(l_orderkey" in plan(log)
        assert plan(log).count("REPARTITION_BY_NUM") >= 2
        few = {tuple(r) for r in log.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert few == {tuple(r) for r in Views(spark, folder)["player_game_log"].collect()}


@pytest.mark.parametrize("name", ["season_ranks", "norm_season_totals", "schema_catalog"])
def test_totals_are_made_once(spark, folder, name):
    """What is read again is read from where it was written, not made of order lines again."""
    assert "lineitem.parquet" not in plan(QUERIES[name](spark, folder))


def test_increment_makes_its_tables_once(spark, folder):
    assert "lineitem.parquet" not in plan(QUERIES["season_increment"](spark, folder))


def test_stored_tables_keep_their_rows(spark, folder, tmp_path):
    views = Views(spark, folder)
    stored = views.stored(str(tmp_path / "w"), ["player_game_log", PGTT])
    for name in ("player_game_log", PGTT):
        columns = views[name].columns
        assert stored[name].select(columns).exceptAll(views[name]).isEmpty()
        assert views[name].exceptAll(stored[name].select(columns)).isEmpty()
