"""One question: run its SQL, show the first rows, compare with a gold statement."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession

from courtside.plans.evaluation import evaluate
from courtside.plans.statements import run_sql


@dataclass
class Answer:
    ok: bool
    columns: list[str] = field(default_factory=list)
    rows: list[Row] = field(default_factory=list)
    more: bool = False
    error: str = ""
    scores: Row | None = None


def ask(
    spark: SparkSession, sql: str, gold_sql: str | None = None, max_rows: int = 20
) -> Answer:
    """Run a predicted statement; with a gold one also distance and correctness.

    Only ``max_rows`` rows come to the driver; ``more`` says that there are others.
    """
    outcome = run_sql(spark, sql)
    answer = Answer(outcome.ok, error=outcome.message)
    if outcome.df is not None:
        try:
            taken = outcome.df.take(max_rows + 1)
            answer.columns = outcome.df.columns
            answer.rows, answer.more = taken[:max_rows], len(taken) > max_rows
        except Exception as error:  # noqa: BLE001 - a run-time error of the statement
            answer = Answer(False, error=str(error))
    if gold_sql is not None:
        pair = spark.createDataFrame([(gold_sql, sql)], "gold_sql string, pred_sql string")
        columns = ("dist", "sim", "gold_ok", "pred_err", "correct")
        answer.scores = evaluate(spark, pair).select(*columns).first()
    return answer
