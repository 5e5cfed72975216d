"""Scoring a corpus of questions, gold SQL and predicted SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.sqltext import (
    classify_condition,
    sql_tokens,
    token_distance,
    token_similarity,
)
from courtside.operators.results import (
    GOLD,
    PRED,
    compare_ordered,
    compare_results,
    gapless_positions,
    sums_of,
)
from courtside.plans.statements import ordered_rows, run_statements
from courtside.session import broadcast_if_small, pin, spread


def with_distances(df: DataFrame, gold: str = "gold_sql", pred: str = "pred_sql") -> DataFrame:
    """Add token ``dist`` and ``sim`` of gold and predicted SQL; NULL counts as empty."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in (gold, pred)]
    tokens = df.withColumns({"_g": sql_tokens(texts[0]), "_p": sql_tokens(texts[1])})
    measured = tokens.withColumn("dist", token_distance("_g", "_p"))
    return measured.withColumn(
        "sim", token_similarity("_g", "_p", F.col("dist"))
    ).drop("_g", "_p")


def _text_key(sql: str) -> Column:
    """A short key of a text, of its own for NULL, so that joins neither carry nor lose it."""
    return F.coalesce(F.md5(F.col(sql).cast("binary")), F.lit("NULL"))


def _texts(statements: DataFrame) -> Iterator[tuple[int, str]]:
    for row in statements.select("statement_id", "sql").toLocalIterator():
        yield row.statement_id, row.sql


def execute_pairs(
    spark: SparkSession,
    pairs: DataFrame,
    chunk: int = 20,
    ordered: bool = False,
    seconds: float | None = None,
) -> DataFrame:
    """Run and compare distinct ``(gold_sql, pred_sql)`` pairs with a ``pair_id``.

    ``pairs`` must be pinned. Adds ``gold_ok``, ``pred_err`` (empty if it ran),
    ``error_class`` and ``correct``. Every distinct statement runs once.
    """
    keyed = pairs.withColumns({"_gold": _text_key("gold_sql"), "_pred": _text_key("pred_sql")})
    texts = pairs.select(F.explode(F.array("gold_sql", "pred_sql")).alias("sql"))
    distinct = texts.groupBy(_text_key("sql").alias("_key")).agg(F.first("sql").alias("sql"))
    statements = pin(distinct.withColumn("statement_id", F.monotonically_increasing_id()))
    shape = {"shape": ordered_rows} if ordered else {}
    rows, outcomes = run_statements(spark, _texts(statements), chunk, seconds=seconds, **shape)
    if ordered:
        rows = gapless_positions(rows, ["statement_id"])
    error_class = classify_condition("condition", F.col("unknown_qualifier"))
    known = statements.join(outcomes, "statement_id").select(
        "statement_id", "_key", "ok", "message", error_class.alias("error_class")
    )
    gold = known.select(
        F.col("_key").alias("_gold"),
        F.col("statement_id").alias("gold_id"),
        F.col("ok").alias("gold_ok"),
    )
    pred = known.select(
        F.col("_key").alias("_pred"),
        F.col("statement_id").alias("pred_id"),
        F.col("ok").alias("pred_ok"),
        F.when(F.col("ok"), "").otherwise(F.col("message")).alias("pred_err"),
        F.when(~F.col("ok"), F.col("error_class")).alias("error_class"),
    )
    gold, pred = broadcast_if_small(pin(gold)), broadcast_if_small(pin(pred))
    judged = pin(keyed.join(gold, "_gold").join(pred, "_pred"))
    both_ran = F.col("gold_ok") & F.col("pred_ok")
    same = F.col("gold_id") == F.col("pred_id")
    # Equal statements give equal results, and results with unequal sums differ; only the
    # others need their rows.
    ran = judged.filter(both_ran & ~same).withColumn("example_id", F.col("pair_id"))
    sums = pin(sums_of(rows, "statement_id", ordered))
    for side in ("gold", "pred"):
        named = sums.select(F.col("statement_id").alias(f"{side}_id"), F.col("sums").alias(f"_{side}_sums"))
        ran = ran.join(broadcast_if_small(named), f"{side}_id", "left")
    alike = F.col("_gold_sums").eqNullSafe(F.col("_pred_sums"))
    ran = pin(ran.filter(alike).select("example_id", "gold_id", "pred_id"))
    sides = ran.select(
        "example_id",
        F.explode(
            F.array(
                F.struct(F.lit(GOLD).alias("side"), F.col("gold_id").alias("statement_id")),
                F.struct(F.lit(PRED).alias("side"), F.col("pred_id").alias("statement_id")),
            )
        ).alias("s"),
    ).select("example_id", "s.side", "s.statement_id")
    # Broadcast, the pairs meet the rows where these are read, and equal rows are
    # counted there before anything is shuffled.
    sides = broadcast_if_small(sides)
    compare = compare_ordered if ordered else compare_results
    equal = compare(rows.join(sides, "statement_id"), ran)
    equal = equal.withColumnRenamed("example_id", "pair_id")
    correct = F.when(~both_ran, 0).when(same, 1).otherwise(F.coalesce("correct", F.lit(0)))
    return judged.join(equal, "pair_id", "left").select(
        *pairs.columns, "gold_ok", "pred_err", "error_class", correct.alias("correct")
    )


def evaluate(
    spark: SparkSession,
    examples: DataFrame,
    chunk: int = 20,
    ordered: bool = False,
    seconds: float | None = None,
) -> DataFrame:
    """Outcome rows for ``report``: examples with distances and execution results.

    ``examples`` has ``gold_sql`` and ``pred_sql``, and any of ``difficulty`` and
    ``verdict``; other columns are kept. Pairs that occur many times are measured and
    run once. A NULL text is a failed statement: without its gold an example doesn't
    count, without its prediction it counts as failed.

    Results are equal as bags of stripped texts, or, if ``ordered``, row by row as they
    are; a result is in the order of its statement's own ORDER BY. ``seconds`` limits every
    statement (see ``run_statements``).
    """
    defaults = {"difficulty": F.lit("unknown"), "verdict": F.lit(None).cast("string")}
    missing = {c: v for c, v in defaults.items() if c not in examples.columns}
    full = examples.withColumns(missing) if missing else examples
    distinct = full.select("gold_sql", "pred_sql").distinct()
    pairs = pin(distinct.withColumn("pair_id", F.monotonically_increasing_id()))
    executed = execute_pairs(spark, pairs, chunk, ordered, seconds).drop("gold_sql", "pred_sql")
    scored = with_distances(spread(pairs)).join(executed, "pair_id")
    texts = ["gold_sql", "pred_sql"]
    known = scored.select(
        F.concat_ws("|", *[_text_key(c) for c in texts]).alias("_pair"),
        *[c for c in scored.columns if c not in (*texts, "pair_id")],
    )
    keyed = full.withColumn("_pair", F.concat_ws("|", *[_text_key(c) for c in texts]))
    joined = keyed.join(known, "_pair").drop("_pair")
    return joined.select(*texts, *[c for c in joined.columns if c not in texts])
