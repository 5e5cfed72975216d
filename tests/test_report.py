import json
import random
import statistics

import numpy as np
import pytest

from courtside.operators import report

OUTCOME = (
    "example_id int, difficulty string, gold_ok boolean, pred_err string, correct int, "
    "dist int, sim double, verdict string"
)


def outcomes(spark):
    return spark.createDataFrame(
        [
            (1, "easy", True, "", 1, 2, 0.9, "CORRECT"),
            (2, "Easy", True, None, 0, 4, 0.8, "PARTIAL"),
            (3, "hard", True, "syntax error at or near", 0, 9, 0.1, "ERROR"),
            (4, "hard", False, "", 0, 5, 0.5, "CORRECT"),
            (5, "odd", True, "timeout", 1, 1, 0.7, "INCORRECT"),
        ],
        OUTCOME,
    )


def test_accuracy_and_stats(spark):
    df = outcomes(spark)
    row = report.execution_accuracy(df).first()
    # A failed prediction is wrong whatever its flag says; a failed gold does not count.
    assert tuple(row) == (4, 1, 0.25)
    assert tuple(report.edit_stats(df).first()) == (4, 4.0, 0.625)
    assert tuple(report.edit_stats(df, parity=True).first()) == (4, 5.25, 0.75)
    assert tuple(report.exec_fail_rate(df).first()) == (2, 0.5)


def test_levels_and_errors(spark):
    levels = {r.level: tuple(r)[2:] for r in report.difficulty_breakdown(outcomes(spark)).collect()}
    assert levels == {
        "all": (5, 0.2, 0.4, 4.2),
        "easy": (2, 0.5, 0.0, 3.0),
        "hard": (2, 0.0, 0.5, 7.0),
    }
    rows = report.error_breakdown(outcomes(spark)).collect()
    assert [tuple(r) for r in rows] == [("syntax_error", 1), ("timeout_or_cancelled", 1)]


def test_summary(spark):
    rows = {r.metric: r.value for r in report.eval_summary(outcomes(spark)).collect()}
    assert rows["n"] == 4 and rows["execution_accuracy"] == 0.25
    assert (rows["judge_correct"], rows["judge_partial"], rows["judge_incorrect"]) == (
        0.25, 0.25, 0.5,
    )
    parity = {r.metric: r.value for r in report.eval_summary(outcomes(spark), True).collect()}
    assert parity["judge_correct"] == 0.5 and parity["avg_edit_distance"] == 5.25


def test_summary_without_valid_examples(spark):
    none = outcomes(spark).filter("NOT gold_ok")
    assert [r.metric for r in report.eval_summary(none).collect()] == ["no valid examples"]
    empty = outcomes(spark).filter("example_id < 0")
    assert [r.metric for r in report.eval_summary(empty).collect()] == ["no valid examples"]


def test_summary_lines(spark):
    rows = report.summary_lines(outcomes(spark)).orderBy("line_no").collect()
    lines = [r.line for r in rows]
    assert lines[:4] == ["=" * 20, "EVAL SUMMARY", "=" * 20, "n: 4"]
    assert lines[4] == "execution_accuracy: 0.25 (1/4)"
    assert "easy: n=2, accuracy=0.5, fail_rate=0.0, avg_edit_distance=3.0" in lines
    at = lines.index("error_breakdown:")
    assert lines[at + 1 : at + 3] == ["syntax_error: 1", "timeout_or_cancelled: 1"]
    assert [x.split("0")[0] for x in lines[at + 3 :]] == [
        "judge_correct:   ", "judge_partial:   ", "judge_incorrect: ",
    ]


def test_no_lines_without_valid_examples(spark):
    assert report.summary_lines(outcomes(spark).filter("NOT gold_ok")).count() == 0


def test_null_verdict_is_unknown(spark):
    df = spark.createDataFrame([('{"verdict": null, "reasoning": "r"}',)], "reply string")
    assert df.select(report.parse_verdict("reply").alias("p")).first().p.verdict == "UNKNOWN"


@pytest.mark.parametrize("case", ["random", "same", "tenths", "two"])
def test_histogram_against_numpy(spark, case):
    rng = random.Random(1)
    values = {
        "random": [rng.randint(0, 97) for _ in range(500)],
        "same": [4] * 9,
        "tenths": [round(0.1 * i, 1) for i in range(101)],
        "two": [1, 1, 3],
    }[case]
    df = spark.createDataFrame([(float(v),) for v in values], "dist double")
    rows = report.histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(values, dtype=float), bins=20)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1], abs=1e-4)
    assert rows[0].median == pytest.approx(statistics.median(values), abs=1e-4)
    assert rows[0].mean == pytest.approx(statistics.fmean(values), abs=1e-4)


def test_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "dist int")
    assert tuple(report.edit_percentiles(df).first()) == (2.5, 3.7)


def test_exact_match(spark):
    df = spark.createDataFrame([(" a ", "a"), ("a", "b")], "g string, p string")
    assert tuple(report.exact_match(df, "g", "p").first()) == (2, 1, 0.5)


@pytest.mark.parametrize(
    "reply",
    [
        '```json\n{"verdict": "CORRECT", "reasoning": "é"}\n```',
        '{"verdict": "A", "reasoning": "b", "x": [1, {"verdict": 2}]}',
        '{"reasoning": "r"}',
        "{}",
        "oops",
        "[1]",
        "",
        '{"verdict": "A"} tail',
        '{"verdict": "A"}, {"verdict": "B"}',
        "{'verdict': 'A'}",
        '{"verdict": null}',
        '{"verdict": "A",}',
    ],
)
def test_parse_verdict_against_json(spark, reply):
    df = spark.createDataFrame([(reply,)], "r string")
    got = df.select(report.parse_verdict("r").alias("p")).select("p.*").first()
    text = reply.replace("```json", "").replace("```", "").strip()
    try:
        parsed = json.loads(text)
        # A null verdict is no verdict, as an absent one.
        verdict = parsed.get("verdict", "UNKNOWN")
        want = ("UNKNOWN" if verdict is None else verdict, parsed.get("reasoning", ""))
    except Exception:  # noqa: BLE001
        want = ("ERROR", "reply is not a JSON object")
    assert tuple(got) == want


def test_verdict_rates(spark):
    df = outcomes(spark).select("verdict")
    apart = {r.verdict: r["count"] for r in report.verdict_rates(df).collect()}
    assert apart == {"CORRECT": 2, "PARTIAL": 1, "INCORRECT": 1, "ERRORS": 1}
    together = {r.verdict: r.share for r in report.verdict_rates(df, "incorrect").collect()}
    assert together == {"CORRECT": 0.4, "PARTIAL": 0.2, "INCORRECT": 0.4}


def test_compare_models(spark):
    df = outcomes(spark)
    from pyspark.sql import functions as F

    both = df.withColumn("model", F.lit("m1")).unionByName(
        df.withColumn("model", F.lit("m2")).withColumn("dist", F.col("dist") + 1)
    )
    rows = {r.metric: (r.m1, r.m2) for r in report.compare_models(both, ["m1", "m2"]).collect()}
    assert rows["avg_edit_distance"] == (4.0, 5.0)
    assert rows["execution_accuracy"] == (0.25, 0.25)
