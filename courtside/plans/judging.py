"""A judge's opinion of every question and its SQL result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.cleaning import strip
from courtside.operators.corpus import Predictor, judge_prompt, predict_sql
from courtside.operators.report import parse_verdict
from courtside.operators.results import result_preview
from courtside.plans.statements import first_rows, run_statements
from courtside.session import pin

# The columns of a judge's result file.
JUDGED_COLUMNS = ["natural_query", "sql", "result_preview", "verdict", "reasoning"]


def preview_statements(
    spark: SparkSession, statements: DataFrame, max_rows: int = 50, chunk: int = 20
) -> DataFrame:
    """Add ``result_preview`` and ``error`` to pinned ``(statement_id, sql)`` rows."""
    texts = (
        (r.statement_id, r.sql)
        for r in statements.select("statement_id", "sql").toLocalIterator()
    )
    rows, outcomes = run_statements(spark, texts, chunk, first_rows(max_rows))
    keyed = rows.withColumnRenamed("statement_id", "example_id")
    counts = keyed.filter(F.col("pos").isNull()).select(
        "example_id", F.col("row")[0].cast("bigint").alias("_n")
    )
    headers = outcomes.select(
        F.col("statement_id").alias("example_id"), F.col("columns").alias("header")
    )
    shown = keyed.filter(F.col("pos").isNotNull())
    previews = result_preview(shown, headers, max_rows, counts)
    return (
        statements.join(
            previews.withColumnRenamed("example_id", "statement_id"), "statement_id"
        )
        .join(outcomes.select("statement_id", F.col("message").alias("error")), "statement_id")
        .withColumnRenamed("preview", "result_preview")
    )


def judge_corpus(
    spark: SparkSession,
    corpus: DataFrame,
    make_judge: Callable[[], Predictor],
    max_rows: int = 50,
) -> DataFrame:
    """Run each ``output`` statement, show it to the judge with its ``input`` question.

    ``make_judge`` is called once per partition; its predictor answers a list of
    prompts with as many replies. The columns are those of the result file.
    """
    pairs = corpus.select(
        strip(F.coalesce("input", F.lit(""))).alias("natural_query"),
        strip(F.coalesce("output", F.lit(""))).alias("sql"),
    )
    pairs = pin(pairs.withColumn("example_id", F.monotonically_increasing_id()))
    distinct = pairs.select("sql").distinct()
    statements = pin(distinct.withColumn("statement_id", F.monotonically_increasing_id()))
    previews = preview_statements(spark, statements, max_rows).drop("statement_id")
    asked = pin(
        judge_prompt(pairs.join(previews, "sql"), "natural_query", "sql", "result_preview")
    )
    replies = predict_sql(asked, make_judge, question="prompt", clean=False)
    verdicts = replies.select("example_id", parse_verdict("reply").alias("p"))
    judged = asked.join(verdicts, "example_id")
    return judged.select(
        "natural_query", "sql", "result_preview", "p.verdict", "p.reasoning"
    )
