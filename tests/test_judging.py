from courtside.plans.judging import JUDGED_COLUMNS, judge_corpus


def strict_judge():
    def reply(prompts):
        verdicts = ["INCORRECT" if "SQL ERROR" in p else "CORRECT" for p in prompts]
        return [f'```json {{"verdict": "{v}", "reasoning": "r"}}```' for v in verdicts]

    return reply


def test_judge_corpus(spark):
    numbers = spark.range(60).selectExpr("id AS n", "nullif(id, 59) AS v")
    numbers.repartition(4).createOrReplaceTempView("numbers")
    corpus = spark.createDataFrame(
        [
            ("which ", "SELECT n, v FROM numbers ORDER BY n DESC;"),
            ("again", "SELECT n, v FROM numbers ORDER BY n DESC;"),
            ("none", "SELECT n FROM numbers WHERE n < 0"),
            ("bad", "SELECT nope FROM numbers"),
        ],
        "input string, output string",
    )
    judged = judge_corpus(spark, corpus, strict_judge, max_rows=3)
    assert judged.columns == JUDGED_COLUMNS
    got = {r.natural_query: r for r in judged.collect()}
    shown = f"n | v\n{'-' * 20}\n59 | \n58 | 58\n57 | 57\n... (57 rows not shown)\n"
    assert got["which"].result_preview == got["again"].result_preview == shown
    assert got["none"].result_preview == f"n\n{'-' * 20}\n"
    assert got["bad"].result_preview == "(no rows returned)"
    assert [got[q].verdict for q in ("which", "none", "bad")] == [
        "CORRECT", "CORRECT", "INCORRECT",
    ]
    spark.catalog.dropTempView("numbers")
