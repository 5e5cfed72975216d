"""What the optimizer makes of the queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from courtside.catalogue import QUERIES
from courtside.catalogue.evaluation import stored_views
from courtside.fixtures import Views
from courtside.operators import keys, stats

# These run jobs while they are built, or are Python by nature.
EAGER = {
    "run_sql_safe", "evaluate_statements", "load_order", "csv_scan", "corpus_scan",
    "corpus_sink", "summary_sink", "replace_all", "season_increment", "batch_predict",
    "statement_timeouts", "evaluate_ordered",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_and_no_cross_product(name, spark, folder):
    text = plan(driver.queries()[name](spark, folder))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert node not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_top_k_is_taken_per_task(spark, folder):
    text = plan(driver.queries()["top_scorers"](spark, folder))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize(
    "name", ["dedupe_first", "result_preview", "league_leaders", "best_scorer_per_team_season"]
)
def test_windows_are_cut_before_the_shuffle(name, spark, folder):
    text = plan(driver.queries()[name](spark, folder))
    assert "WindowGroupLimit" in text and ", Partial" in text


def test_stored_season_query_reads_one_partition_and_few_columns(spark, folder):
    with stored_views(Views(spark, folder)):
        tables = {n: spark.table(n) for n in ("player", "player_season")}
        text = plan(stats.top_players(tables, "player_season", "pts", 21998))
    assert "season_id" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<player_id:int,pts:float>" in text


def test_insert_ignore_does_not_shuffle_the_targets_rows(spark, tmp_path):
    path = str(tmp_path / "target")
    spark.range(100).select("id", F.col("id").alias("wide")).write.parquet(path)
    target = spark.read.parquet(path)
    text = plan(keys.insert_ignore(target, target, ["id"], ["wide"]))
    first = text.split("Union")[1]
    # The first branch of the union is the bare scan.
    assert first.index("FileScan") < first.index("Exchange")


def test_leaders_are_cut_before_names_are_joined(spark, folder):
    with stored_views(Views(spark, folder)):
        names = ("player", "team", "player_season", "player_general_traditional_total")
        tables = {n: spark.table(n) for n in names}
        best, leaders = stats.best_per_team_season(tables), stats.league_leaders(tables, ["gp"])
        optimized = best._jdf.queryExecution().optimizedPlan().toString()
        named = leaders._jdf.queryExecution().optimizedPlan().toString()
    # The best are cut out, not found by a maximum that is joined back.
    assert optimized.count("WindowGroupLimit") == 1 and "Aggregate" not in optimized
    # The tree is printed from the top: the cut stands below the join of the names.
    assert named.rindex("WindowGroupLimit") > named.index("Join")


def test_missing_ids_are_dealt_out(spark):
    events = spark.range(10_000).selectExpr(
        "CAST(id AS string) AS game_id", "CAST(id AS int) AS event_num", "1 AS event_msg_type_id",
        "CAST(CASE WHEN id < 50 THEN id END AS int) AS player1_id",
    )
    dims = {
        "event_message_type": spark.createDataFrame([(1, "Made")], "id int, string string"),
        "player": spark.createDataFrame([(i, f"p{i}") for i in range(60)], "player_id int, player_name string"),
        "team": spark.createDataFrame([], "team_id int, nickname string"),
    }
    dims["player"] = dims["player"].hint("merge")
    decoded = stats.decode_events(dims | {"play_by_play": events})
    assert decoded.where("player1_name IS NULL").count() == 9_950
    assert decoded.count() == 10_000
    keyed = stats._look_up(
        events, dims["player"].withColumnRenamed("player_id", "player1_id"), "player1_id"
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    sizes = keyed.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset(coalesce)
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2 * 10_000 / len(sizes)
