import random

import pytest

from courtside.operators import integrity as checks
from courtside.schemas import TABLES

LOG = TABLES["player_game_log"]
SCHEMA = "player_id int, game_id string, team_id int, wl string, o int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [
        (
            rng.choice([None, 1, 2, 3, 4, 99]),
            rng.choice(["g1", "g2", "g3", "lost"]),
            rng.choice([None, 10, 11, 77]),
            rng.choice(["W", "L", None, "WW"]),
            i,
        )
        for i in range(300)
    ]


def parents(spark):
    return {
        "player": spark.createDataFrame([(1,), (2,), (3,), (4,)], "player_id int"),
        "game": spark.createDataFrame([("g1",), ("g2",), ("g3",)], "game_id string"),
        "team": spark.createDataFrame([(10,), (11,)], "team_id int"),
    }


def wanted(row):
    player, game, team, wl, _ = row
    reasons = []
    if wl == "WW":
        reasons.append("wl: too long")
    if player is None:
        reasons.append("player_id: null key")
    if player == 99:
        reasons.append("player_id: no such player")
    if game == "lost":
        reasons.append("game_id: no such game")
    if team == 77:
        reasons.append("team_id: no such team")
    return reasons


def test_split_valid_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    good, rejects = checks.split_valid(df, LOG, parents(spark), ["o"])
    seen, want_good, want_bad = set(), set(), {}
    for row in rows:
        reasons = wanted(row)
        if not reasons and row[:2] in seen:
            reasons = ["player_id, game_id: duplicate key"]
        if reasons:
            want_bad[row[4]] = sorted(reasons)
        else:
            seen.add(row[:2])
            want_good.add(row[4])
    assert {r.o for r in good.collect()} == want_good
    assert {r.o: sorted(r._reasons) for r in rejects.collect()} == want_bad


def test_split_valid_batches_against_brute_force(spark, rows):
    rows = [(r[0], f"{r[1]}-{i // 4}" if r[1] != "lost" else r[1], *r[2:]) for i, r in enumerate(rows)]
    known = {r[1] for r in rows if r[1] != "lost"}
    all_parents = parents(spark)
    all_parents["game"] = spark.createDataFrame([(g,) for g in known], "game_id string")
    df = spark.createDataFrame(rows, SCHEMA)
    good, rejects = checks.split_valid_batches(df, "game_id", LOG, all_parents)
    bad = {r[1] for r in rows if wanted(r)}
    assert bad and bad != {r[1] for r in rows}
    assert {r.o for r in good.collect()} == {r[4] for r in rows if r[1] not in bad}
    assert {r.o for r in rejects.collect()} == {r[4] for r in rows if r[1] in bad}


def test_many_orphans_take_the_plain_join(spark, rows, monkeypatch):
    monkeypatch.setattr(checks, "is_small", lambda df: False)
    monkeypatch.setattr(checks, "broadcast_if_small", lambda df: df)
    df = spark.createDataFrame(rows, SCHEMA)
    _, rejects = checks.split_valid(df, LOG, parents(spark), ["o"])
    orphaned = {r.o for r in rejects.collect() if "no such" in " ".join(r._reasons)}
    assert orphaned == {r[4] for r in rows if "no such" in " ".join(wanted(r))}


def test_a_column_of_many_orphans_does_not_shuffle_the_rows(spark):
    """Before, 200,001 orphan keys sent all rows of the table through a shuffle."""
    df = spark.range(250_000).selectExpr("CAST(id AS int) AS player_id", "id AS o")
    players = spark.createDataFrame([(i,) for i in range(10)], "player_id int")
    flagged = checks.flag_orphans(df, LOG, {"player": players})
    text = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert flagged.where(checks.is_good()).count() == 10


def test_report_and_samples(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = checks.flag_rows(df, LOG, parents(spark))
    report = checks.load_report({"log": flagged}).first()
    bad = [r for r in rows if wanted(r)]
    assert (report.inserted, report.total, report.errors) == (
        len(rows) - len(bad), len(rows), len(bad),
    )
    samples = checks.reject_samples({"log": flagged}, ["o"]).collect()
    assert [s.error_number for s in samples] == [1, 2, 3]
    assert [s.reasons.split("; ") for s in samples] == [wanted(r) for r in bad[:3]]
    assert f'"o":{bad[0][4]}' in samples[0].row_values
