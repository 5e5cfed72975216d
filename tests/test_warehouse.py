import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from courtside.plans import versions, warehouse
from courtside.plans.warehouse import (
    SeasonInputs,
    build_warehouse,
    load_all,
    read_warehouse,
    store_season,
)
from courtside.sources.feeds import align, normalise_player, normalise_team
from courtside.sources.files import read_corpus, read_table_csv, write_csv, write_summary
from courtside.schemas import TABLES
from courtside.streaming.season_feed import log_feed, season_feed


def write(folder, name, text):
    (folder / f"{name}.csv").write_text(text, encoding="utf-8")


@pytest.fixture
def csv_folder(tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder, "team", "TEAM_ID,Abbreviation,nickname,year_founded,city\n"
          "1610612737,ATL,Hawks,1949,Atlanta\n1610612738,BOS,Celtics,1946,Boston\n")  # fmt: skip
    write(folder, "player", "player_id,player_name,college,country\n1,Al,NA,USA\n2.0,Bo, ,\n"
          f"3,{'x' * 300},,\n1,Again,,\nfour,Di,,\n")  # fmt: skip
    write(folder, "game", "game_id,team_id_home_id,team_id_away_id,season_id,date\n"
          "0021,1610612737,,22023,2023-10-24\n0022,5,,22023,2023-10-25\n,1610612737,,22023,\n")  # fmt: skip
    write(folder, "player_game_log", "player_id,game_id,team_id,season_id,wl,pts,min\n"
          "1,0021,1610612737,22023,W,30.5,NaN\n2,0021,,22023,L,7,12\n3,0021,,22023,L,7,12\n"
          "1,0022,,22023,W,1,1\n2,0021,,22023,L,8,1\n")  # fmt: skip
    write(folder, "player_season", "player_id,season_id,gp,nonsense\n1,22023,70.5,x\n")
    return folder


def test_load_all(spark, csv_folder, tmp_path):
    load = load_all(spark, str(csv_folder), str(tmp_path / "out"))
    assert load.skipped == [
        "event_message_type", "player_general_traditional_total", "player_career_totals",
    ]
    counts = {r.table_name: (r.inserted, r.total, r.errors) for r in load.report.collect()}
    assert counts == {
        "team": (2, 2, 0),
        "player": (2, 5, 3),
        "game": (1, 3, 2),
        "player_game_log": (2, 5, 3),
        "player_season": (0, 1, 1),
    }
    players = load.tables["player"].orderBy("player_id").collect()
    assert [(p.player_id, p.player_name, p.college) for p in players] == [
        (1, "Al", None), (2, "Bo", None),
    ]
    log = {r.player_id: r for r in load.tables["player_game_log"].collect()}
    assert log[1].game_id == "0021" and log[1].pts == 30.5 and log[1].min is None
    reasons = {
        (r.table_name, r.error_number): r.reasons for r in load.samples.collect()
    }
    assert reasons["player", 1] == "player_name: too long"
    assert reasons["player", 2] == "player_id: duplicate key"
    assert reasons["player", 3] == "player_id: not a valid int; player_id: null key"
    assert reasons["game", 1] == "team_id_home_id: no such team"
    assert reasons["player_game_log", 1] == "player_id: no such player"
    assert reasons["player_game_log", 3] == "player_id, game_id: duplicate key"
    assert "unknown column: nonsense" in reasons["player_season", 1]


def test_checked_rows_are_written_where_they_are(spark, csv_folder, tmp_path):
    """Before, the wide rows were shuffled and sorted once more to be written."""
    lines = "".join(f"1,g{i},1610612737,{22000 + i % 3},W,1,1\n" for i in range(300))
    write(csv_folder, "player_game_log", "player_id,game_id,team_id,season_id,wl,pts,min\n" + lines)
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "3000")
    try:
        tasks = spark.read.text(f"{csv_folder}/player_game_log.csv").rdd.getNumPartitions()
        load = load_all(spark, str(csv_folder), str(tmp_path / "out"))
        assert load.report.where("table_name = 'player_game_log'").first().total == 300
    finally:
        spark.conf.unset(key)
    files = list((tmp_path / "out" / "player_game_log").rglob("*.parquet"))
    assert tasks > 1 and len(files) > 3


def test_compressed_files_load_alike(spark, tmp_path):
    teams = spark.createDataFrame([(1, "A,\n\"x\""), (2, " b ")], "team_id int, nickname string")
    for name, how in (("plain", None), ("packed", "gzip")):
        write_csv(teams, str(tmp_path / name / "team.csv"), compression=how)
        load = load_all(spark, str(tmp_path / name), str(tmp_path / name / "out"))
        rows = load.tables["team"].orderBy("team_id").collect()
        assert [(r.team_id, r.nickname) for r in rows] == [(1, "A,\n\"x\""), (2, " b ")]
    assert list((tmp_path / "packed" / "team.csv").glob("*.csv.gz"))


def test_gp_is_truncated_by_name(spark, csv_folder):
    rows = read_table_csv(spark, f"{csv_folder}/player_season.csv", TABLES["player_season"])
    assert rows.first().gp == 70.0


TEAMS = "id int, nickname string, year_founded int"


def season(spark, label, pts, extra=()):
    players = [("1", "Al", "1999", 0), ("2", "Bo", "", 1), ("1", "Al again", "x", 2)]
    return SeasonInputs(
        label,
        ["o"],
        players=spark.createDataFrame(
            players, "PLAYER_ID string, PLAYER_NAME string, DRAFT_YEAR string, o int"
        ),
        games=spark.createDataFrame(
            [("g1", "10", f"2{label[:4]}", f"{label[:4]}-11-01", 1), ("g1", "11", "x", "x", 2)],
            "GAME_ID string, TEAM_ID string, SEASON_ID string, GAME_DATE string, o int",
        ),
        player_season=spark.createDataFrame(
            [("1", "10", "6-5", pts, 1), ("9", "10", "6-5", pts, 2)],
            "PLAYER_ID string, TEAM_ID string, PLAYER_HEIGHT string, PTS double, o int",
        ),
        game_log=spark.createDataFrame(
            [("1", "g1", "10", f"2{label[:4]}", pts, 1), ("1", "g1", "10", "x", 0.0, 2),
             ("2", "g1", "10", f"2{label[:4]}", 1.0, 1), ("2", "gone", "10", "1", 1.0, 2), *extra],
            "PLAYER_ID string, Game_ID string, TEAM_ID string, SEASON_ID string, PTS double, o int",
        ),
        play_by_play=spark.createDataFrame(
            [("g1", "1", "1", "1"), ("g1", "2", "1", None), ("other", "3", "1", "1")],
            "GAME_ID string, EVENTNUM string, EVENTMSGTYPE string, PLAYER1_ID string",
        ),
    )


def test_seasons_are_stored_one_after_another(spark, tmp_path):
    root = str(tmp_path / "root")
    spark.createDataFrame(
        [(10, "A", "a", "", "x"), (11, "B", "b", "", "y")], TABLES["team"].schema
    ).write.parquet(f"{root}/team")
    spark.createDataFrame([(1, "Made Shot")], TABLES["event_message_type"].schema).write.parquet(
        f"{root}/event_message_type"
    )
    rejects = store_season(spark, root, season(spark, "2022-23", 20.0))
    # Player 9 is unknown; player 2 loses all his logs to one bad game.
    assert [r.player_id for r in rejects["player_season"].collect()] == [9]
    assert {r.player_id for r in rejects["player_game_log"].collect()} == {2}
    store_season(spark, root, season(spark, "2022-23", 33.0))
    tables = read_warehouse(spark, root)
    assert {(p.player_id, p.player_name) for p in tables["player"].collect()} == {
        (1, "Al"), (2, "Bo"),
    }
    stats = tables["player_season"].collect()
    # Season figures are replaced, logs keep the first value, events are repeated.
    assert [(r.player_id, r.season_id, r.pts, r.player_height_inches) for r in stats] == [
        (1, 22022, 33.0, 77)
    ]
    log = tables["player_game_log"].collect()
    assert [(r.player_id, r.game_id, r.season_id, r.pts) for r in log] == [(1, "g1", 22022, 20.0)]
    assert tables["play_by_play"].count() == 4
    game = tables["game"].first()
    assert (game.team_id_home_id, game.team_id_away_id, str(game.date)) == (10, None, "2022-11-01")
    store_season(spark, root, season(spark, "2023-24", 5.0))
    kept = {r.season_id: r.pts for r in read_warehouse(spark, root)["player_season"].collect()}
    assert kept == {22022: 33.0, 22023: 5.0}


@pytest.mark.parametrize("partitions", [1, 2, 4])
def test_last_arrival_of_a_repeated_key_is_stored(spark, tmp_path, partitions):
    root = str(tmp_path)
    inputs = season(spark, "2022-23", 20.0)
    rows = [("1", "10", "6-5", float(o), o) for o in (3, 8, 1, 5, 2, 7, 4, 6)]
    schema = "PLAYER_ID string, TEAM_ID string, PLAYER_HEIGHT string, PTS double, o int"
    inputs.player_season = spark.createDataFrame(rows, schema).repartition(partitions, "PTS")
    inputs.game_log = inputs.play_by_play = None
    teams = spark.createDataFrame([(10, "A", 1990), (11, "B", None)], TEAMS)
    build_warehouse(spark, root, teams, [inputs])
    stored = read_warehouse(spark, root)["player_season"].collect()
    assert [(r.player_id, r.pts) for r in stored] == [(1, 8.0)]


def test_warehouse_over_seasons_from_nothing(spark, tmp_path):
    root = str(tmp_path)
    teams = spark.createDataFrame([(10, "A", 1990), (11, "B", None)], TEAMS)
    seasons = [season(spark, "2021-22", 9.0), season(spark, "2022-23", 20.0)]
    rejects = build_warehouse(spark, root, teams, seasons)
    assert [set(r) for r in rejects] == [set(rejects[0])] * 2
    assert all(r["game"].count() == 0 for r in rejects)
    tables = read_warehouse(spark, root)
    assert tables["team"].count() == 2 and tables["event_message_type"].count() > 10
    assert {r.season_id for r in tables["player_season"].collect()} == {22021, 22022}
    # Again: dimensions stay single.
    build_warehouse(spark, root, teams, [])
    assert read_warehouse(spark, root)["team"].count() == 2


def test_numbers_out_of_range_reject_their_batch(spark, tmp_path):
    root = str(tmp_path)
    inputs = season(spark, "2022-23", 20.0)
    schema = "PLAYER_ID string, Game_ID string, TEAM_ID string, SEASON_ID string, PTS double, o int"
    rows = [
        ("1", "g1", "10", "22022", 7.0, 1),
        ("2", "g1", "99999999999", "22022", 1.0, 1),
        ("1", "g1", "x1", "22022", 5.0, 2),
    ]
    inputs.game_log = spark.createDataFrame(rows, schema)
    inputs.player_season = spark.createDataFrame(
        [("1", "10", "6-5", 1e40, 1), ("2", "10", "6-5", float("inf"), 2)],
        "PLAYER_ID string, TEAM_ID string, PLAYER_HEIGHT string, PTS double, o int",
    )
    inputs.play_by_play = None
    teams = spark.createDataFrame([(10, "A", 1990), (11, "B", None)], TEAMS)
    rejects = build_warehouse(spark, root, teams, [inputs])[0]
    assert {r.player_id: r._reasons for r in rejects["player_game_log"].collect()} == {
        2: ["team_id: out of range of int"]
    }
    assert {r.player_id: r._reasons for r in rejects["player_season"].collect()} == {
        1: ["pts: out of range of float"]
    }
    stored = read_warehouse(spark, root)
    assert [(r.player_id, r.team_id, r.pts) for r in stored["player_game_log"].collect()] == [(1, 10, 7.0)]


def test_quoted_line_breaks_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "player.csv").write_text('player_id,player_name\n1,"A\nB"\n2, C \n')
    rows = read_table_csv(spark, str(tmp_path / "in" / "player.csv"), TABLES["player"]).collect()
    assert [(r.player_id, r.player_name, r._reasons) for r in rows] == [(1, "A\nB", []), (2, " C ", [])]


def test_log_feed_is_repeatable(spark, tmp_path):
    root, landing = str(tmp_path / "root"), str(tmp_path / "landing")
    first = season(spark, "2022-23", 20.0)
    teams = spark.createDataFrame([(10, "A", "a", "", "x")], TABLES["team"].schema)
    teams.write.parquet(f"{root}/team")
    types = spark.createDataFrame([(1, "Made Shot")], TABLES["event_message_type"].schema)
    types.write.parquet(f"{root}/event_message_type")
    first.game_log = None
    first.play_by_play = None
    store_season(spark, root, first)
    log = season(spark, "2022-23", 20.0).game_log
    log.filter("Game_ID = 'g1'").write.parquet(landing)
    schema = "PLAYER_ID string, Game_ID string, TEAM_ID string, SEASON_ID string, PTS double, o int"
    for checkpoint in ("c1", "c2"):
        feed = log_feed(
            spark, landing, schema, root, str(tmp_path / checkpoint), ["o"], "2022-23"
        )
        feed.awaitTermination(120)
        assert feed.exception() is None
    stored = read_warehouse(spark, root)["player_game_log"].collect()
    assert {(r.player_id, r.game_id, r.pts) for r in stored} == {(1, "g1", 20.0), (2, "g1", 1.0)}


def test_align_rules(spark):
    df = spark.createDataFrame([("1", "x")], "TEAM_ID string, other string")
    assert align(df, TABLES["team"]).first() == (1, None, None, None, None)
    assert align(df, TABLES["team"], on_extra="reject").first()._reasons == [
        "unknown column: other"
    ]
    with pytest.raises(ValueError):
        align(df, TABLES["team"], on_extra="maybe")


def test_normalise_player_and_team(spark):
    raw = spark.createDataFrame(
        [(" 7 ", "Late", 2), ("7", "First", 1)], "PLAYER_ID string, PLAYER_NAME string, o int"
    )
    assert normalise_player(raw, ["o"]).collect() == [(7, "First", None, None, None, None, None)]
    teams = spark.createDataFrame([(1, None), (2, 1990)], "id int, year_founded int")
    got = {r.team_id: r.year_founded for r in normalise_team(teams).collect()}
    assert got == {1: "", 2: "1990"}


def test_corpus_round_trip(spark, tmp_path):
    rows = [('a "b", c\nd', "SELECT 1;"), ("e", "SELECT '\\n'")]
    df = spark.createDataFrame(rows, "input string, output string")
    write_csv(df.coalesce(1), str(tmp_path / "c"))
    back = read_corpus(spark, str(tmp_path / "c"))
    assert sorted((r.input, r.output) for r in back.collect()) == sorted(rows)
    first = read_corpus(spark, str(tmp_path / "c"), limit=1).collect()
    assert [r.input for r in first] == ['a "b", c\nd']


def test_summary_file(spark, tmp_path):
    lines = spark.range(5).select(
        (F.lit(5) - F.col("id")).alias("line_no"), F.col("id").cast("string").alias("line")
    )
    path = write_summary(lines, str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("eval_summary_2024-01-02_03-04-05")
    assert [r.value for r in spark.read.text(path).collect()] == list("43210")


def contents(spark, root):
    """All rows of all six season tables, as text."""
    tables = read_warehouse(spark, root)
    names = ["player", "game", "player_season", "player_game_log", "play_by_play", warehouse.TOTALS]
    return {n: sorted(str(r.asDict()) for r in tables[n].collect()) for n in names}


def whole_season(spark, label, pts):
    inputs = season(spark, label, pts)
    rows = [("1", "10", 5, pts, 1), ("2", "10", 6, 1.0, 1), ("1", "10", 7, pts + 1, 2)]
    inputs.totals = spark.createDataFrame(
        rows, "PLAYER_ID string, TEAM_ID string, GP int, PTS double, o int"
    )
    return inputs


CLUBS = [(10, "A", "a", "", "x"), (11, "B", "b", "", "y")]


@pytest.mark.parametrize("breaks", ["player_game_log", "the version"])
def test_a_season_that_breaks_off_can_be_run_again(spark, tmp_path, monkeypatch, breaks):
    """Nothing of the broken attempt counts; run again, all six tables hold the season once."""
    root = str(tmp_path)
    versions.Draft(spark, root).commit("before")
    inputs = whole_season(spark, "2022-23", 9.0)
    inputs.play_by_play = inputs.play_by_play.withColumn("PLAYER1_ID", F.lit(None).cast("string"))
    for name, rows in (("team", [(10, "A", "a", "", "x"), (11, "B", "b", "", "y")]), ("event_message_type", [(1, "Made")])):
        spark.createDataFrame(rows, TABLES[name].schema).write.parquet(f"{root}/{name}")
    write, commit = versions.Draft.write, versions.Draft.commit

    def failing_write(self, rows, table, season=None):
        if table == breaks:
            raise RuntimeError("killed")
        write(self, rows, table, season)

    def failing_commit(self, batch=None):
        if breaks == "the version":
            raise RuntimeError("killed")
        return commit(self, batch)

    monkeypatch.setattr(versions.Draft, "write", failing_write)
    monkeypatch.setattr(versions.Draft, "commit", failing_commit)
    with pytest.raises(RuntimeError, match="killed"):
        store_season(spark, root, inputs, "b")
    monkeypatch.undo()
    assert all(not rows for rows in contents(spark, root).values())
    assert store_season(spark, root, inputs, "b").applied
    found = contents(spark, root)
    assert {n: len(rows) for n, rows in found.items()} == {
        "player": 2, "game": 1, "player_season": 1, "player_game_log": 1, "play_by_play": 2,
        warehouse.TOTALS: 2,
    }
    assert not store_season(spark, root, inputs, "b").applied
    assert contents(spark, root) == found


def test_ids_last_over_increments(spark, tmp_path):
    root = str(tmp_path / "root")
    teams = spark.createDataFrame(CLUBS, TABLES["team"].schema).withColumnRenamed("team_id", "id")
    warehouse.store_dimensions(spark, root, teams)
    given = {}
    for label, pts in (("2021-22", 1.0), ("2022-23", 2.0), ("2021-22", 3.0)):
        outcome = store_season(spark, root, whole_season(spark, label, pts))
        lost = {r.table_name: (r.repeated_keys, r.rows_replaced) for r in outcome.conflicts.collect()}
        assert lost == {"player_season": (0, 0), warehouse.TOTALS: (1, 1)}
        tables = read_warehouse(spark, root)
        for name in ("player_season", warehouse.TOTALS, "play_by_play"):
            ids = [r.id for r in tables[name].collect()]
            assert None not in ids and len(set(ids)) == len(ids)
        stats = {(r.player_id, r.season_id): r.id for r in tables[warehouse.TOTALS].collect()}
        assert given.items() <= stats.items()
        given = stats
    assert sorted(given.values()) == [1, 2, 3, 4]
    assert sorted(r.id for r in tables["play_by_play"].collect()) == [1, 2, 3, 4, 5, 6]
    assert {r.pts for r in tables[warehouse.TOTALS].where("player_id = 1").collect()} == {3.0, 4.0}


def test_two_writers_are_noticed(spark, tmp_path):
    root = str(tmp_path / "root")
    drafts = [versions.Draft(spark, root), versions.Draft(spark, root)]
    drafts[0].commit("one")
    with pytest.raises(RuntimeError, match="two jobs"):
        drafts[1].commit("two")


def test_events_and_statistics_stream_in_once(spark, tmp_path):
    root, landing = str(tmp_path / "root"), str(tmp_path / "landing")
    teams = spark.createDataFrame(CLUBS, TABLES["team"].schema).withColumnRenamed("team_id", "id")
    first = season(spark, "2022-23", 20.0)
    events, stats = first.play_by_play.withColumn("o", F.lit(1)), first.player_season
    first.play_by_play = first.player_season = first.game_log = None
    warehouse.build_warehouse(spark, root, teams, [first])
    for name, rows in (("play_by_play", events), ("player_season", stats)):
        rows.write.parquet(f"{landing}/{name}")
        schema, checkpoint = rows.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / f"c-{name}")
        for _ in range(2):
            feed = season_feed(
                spark, f"{landing}/{name}", schema, root, checkpoint, ["o"], "2022-23", name
            )
            feed.awaitTermination(120)
            assert feed.exception() is None
            # The stream's own log of what it has done is lost; the warehouse knows.
            shutil.rmtree(f"{checkpoint}/commits")
    tables = read_warehouse(spark, root)
    assert tables["play_by_play"].count() == 2 and tables["player_season"].count() == 1


def test_ids_of_a_csv_are_kept_and_repeats_rejected(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder, "player", "player_id,player_name\n1,A\n2,B\n3,C\n4,D\n5,E\n")
    rows = ["7,1,22023", "7,2,22023", ",3,22023", "x,4,22023", "2,5,22023", ",1,22022"]
    write(folder, "player_season", "id,player_id,season_id\n" + "\n".join(rows) + "\n")
    rows = ["1,22023", "2,22023", "2,22023"]
    write(folder, warehouse.TOTALS, "player_id,season_id\n" + "\n".join(rows) + "\n")
    load = load_all(spark, str(folder), str(tmp_path / "out"))
    stored = {(r.player_id, r.season_id): r.id for r in load.tables["player_season"].collect()}
    assert stored[1, 22023] == 7 and stored[5, 22023] == 2
    assert sorted((stored[3, 22023], stored[1, 22022])) != [None, None]
    assert set(stored) == {(1, 22023), (5, 22023), (3, 22023), (1, 22022)}
    assert len(set(stored.values())) == 4 and min(stored[3, 22023], stored[1, 22022]) > 7
    rejects = {r.player_id: r._reasons for r in load.rejects["player_season"].collect()}
    assert set(rejects) == {2, 4}
    assert "id" in rejects[2][0] and rejects[4] == ["id: not a valid bigint"]
    totals = [(r.player_id, r.id) for r in load.tables[warehouse.TOTALS].collect()]
    assert {p for p, _ in totals} == {1, 2} and {i for _, i in totals} <= {1, 2, 3}
