"""Scores over evaluated examples.

An outcome row is ``(example_id, difficulty, gold_ok, pred_err, correct, dist, sim,
verdict)``: whether the gold SQL ran, the prediction's error text (empty or NULL if it
ran), 0/1 equality, token distance and similarity, and a judge's verdict or NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.cleaning import strip
from courtside.functions.sqltext import classify_sql_error

LEVELS = ["easy", "medium", "hard"]
VERDICTS = ["CORRECT", "PARTIAL", "INCORRECT"]


def _valid() -> Column:
    return F.col("gold_ok")


def _failed() -> Column:
    return F.col("gold_ok") & (F.coalesce("pred_err", F.lit("")) != "")


def _correct() -> Column:
    return F.when(_failed(), 0).otherwise(F.coalesce("correct", F.lit(0)))


def _rate(top: Column, bottom: Column, places: int = 4) -> Column:
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), places)


def execution_accuracy(examples: DataFrame) -> DataFrame:
    """Examples whose gold SQL ran, correct ones among them, and the share."""
    return examples.agg(
        F.count_if(_valid()).alias("n"),
        F.coalesce(F.sum(F.when(_valid(), _correct())), F.lit(0)).alias("correct"),
        F.round(F.avg(F.when(_valid(), _correct())), 4).alias("execution_accuracy"),
    )


def edit_stats(df: DataFrame, parity: bool = False) -> DataFrame:
    """Mean token distance and similarity over valid examples.

    ``parity`` sums over every example but divides by the valid ones, as the original
    report does.
    """
    valid = F.count_if(_valid())

    def mean(column: str) -> Column:
        value = F.col(column).cast("double")
        total = F.sum(value if parity else F.when(_valid(), value))
        return F.round(F.try_divide(total, valid.cast("double")), 4)

    return df.agg(
        valid.alias("n"),
        mean("dist").alias("avg_edit_distance"),
        mean("sim").alias("avg_similarity"),
    )


def exec_fail_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(_failed()).alias("failed"),
        _rate(F.count_if(_failed()), F.count_if(_valid())).alias("pred_sql_exec_fail_rate"),
    )


def difficulty_breakdown(df: DataFrame) -> DataFrame:
    """Totals and per-level figures in one pass; a level's n includes gold failures."""
    level = F.lower("difficulty")
    labelled = df.select(
        level.alias("level"),
        F.when(_valid(), _correct()).otherwise(0).alias("c"),
        _failed().cast("int").alias("f"),
        F.col("dist").cast("double").alias("d"),
    )
    sets = labelled.groupingSets([[], ["level"]], "level").agg(
        F.grouping("level").alias("g"),
        F.count("*").alias("n"),
        _rate(F.sum("c"), F.count("*")).alias("accuracy"),
        _rate(F.sum("f"), F.count("*")).alias("fail_rate"),
        F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 4).alias("avg_edit_distance"),
    )
    name = F.when(F.col("g") == 1, "all").otherwise(F.col("level"))
    order = F.array_position(F.array(*[F.lit(x) for x in ["all", *LEVELS]]), name)
    return (
        sets.select(
            order.cast("int").alias("position"),
            name.alias("level"),
            "n",
            "accuracy",
            "fail_rate",
            "avg_edit_distance",
        )
        .filter(F.col("position") > 0)
        .orderBy("position")
    )


def error_breakdown(df: DataFrame, sql: str | None = None) -> DataFrame:
    """Failed predictions per error class, most frequent first.

    An ``error_class`` column is used as it is; otherwise the error text is classified,
    with the SQL column ``sql`` if given.
    """
    failed = df.filter(_failed())
    if "error_class" in df.columns:
        label = F.col("error_class")
    else:
        label = classify_sql_error("pred_err", sql)
    counted = failed.groupBy(label.alias("error_class")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "error_class")


def exact_match(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Share of predictions that equal the gold text after stripping."""
    same = strip(gold) == strip(pred)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(same).alias("matches"),
        _rate(F.count_if(same), F.count("*")).alias("exact_match_accuracy"),
    )


def edit_percentiles(df: DataFrame, column: str = "dist", approximate: bool = False) -> DataFrame:
    """Median and 90th percentile with linear interpolation.

    The exact form keeps one counter per distinct value; token distances are small
    integers. ``approximate`` bounds the memory for columns with many values.
    """
    value = F.col(column).cast("double")
    pick = F.percentile_approx if approximate else F.percentile
    quantiles = pick(value, [0.5, 0.9])
    return df.agg(quantiles.alias("_q")).select(
        F.round(F.col("_q")[0], 4).alias("median_edit_distance"),
        F.round(F.col("_q")[1], 4).alias("edit_distance_p90"),
    )


def histogram(df: DataFrame, column: str = "dist", bins: int = 20) -> DataFrame:
    """Equal bins over the value range, the last one closed, with mean and median.

    Equal values throughout widen the range by a half on both sides. Rows are first
    counted per distinct value; every bin is listed, empty or not.
    """
    value = F.col(column).cast("double")
    counts = (
        df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    )
    span = counts.agg(
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")).alias("mean"),
        F.percentile("v", 0.5, F.col("n")).alias("median"),
    ).filter(F.col("lo").isNotNull())
    same = F.col("lo") == F.col("hi")
    span = span.withColumns(
        {
            "lo": F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")),
            "hi": F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")),
        }
    )
    # All bins of the one span row, then the value counts joined on the bin number.
    step = (F.col("hi") - F.col("lo")) / bins
    edges = span.select(
        F.posexplode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("pos", "bin"),
        "lo", "hi", "mean", "median",
    ).select(
        (F.col("bin") + 1).alias("bin"),
        (F.col("lo") + F.col("bin") * step).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * step)
        .alias("bin_end"),
        "mean",
        "median",
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    placed = counts.withColumns({"lo": lo, "hi": hi})
    guess = F.least(
        F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
        F.lit(bins - 1),
    ).cast("int")
    # Rounding can put a value next to an edge one bin off; compare with the edges.
    placed = placed.withColumn("i", guess).withColumn("step", step)
    at_edge = F.col("lo") + F.col("i") * F.col("step")
    next_edge = F.col("lo") + (F.col("i") + 1) * F.col("step")
    placed = placed.withColumn(
        "bin",
        F.when(F.col("v") < at_edge, F.col("i"))
        .when((F.col("v") >= next_edge) & (F.col("i") < bins - 1), F.col("i") + 2)
        .otherwise(F.col("i") + 1),
    )
    per_bin = placed.groupBy("bin").agg(F.sum("n").alias("n"))
    return edges.join(per_bin, "bin", "left").select(
        "bin",
        F.round("bin_start", 4).alias("bin_start"),
        F.round("bin_end", 4).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round("mean", 4).alias("mean"),
        F.round("median", 4).alias("median"),
    )


def eval_summary(df: DataFrame, parity: bool = False) -> DataFrame:
    """All metrics of a run as ordered ``(ord, metric, value, numerator, denominator)``.

    Without a single valid example the summary is one row saying so. Metrics with
    judge verdicts appear when there are any. ``parity`` takes distances, similarities
    and verdicts of examples with a failing gold into the sums, over the same n.
    """
    valid = F.count_if(_valid())
    verdict = F.col("verdict")
    counts_for = F.lit(True) if parity else _valid()
    judged = [
        F.count_if(counts_for & (verdict == "CORRECT")),
        F.count_if(counts_for & (verdict == "PARTIAL")),
        F.count_if(counts_for & ~verdict.isin("CORRECT", "PARTIAL")),
    ]

    def total(column: str) -> Column:
        value = F.col(column).cast("double")
        return F.sum(value if parity else F.when(_valid(), value))

    one = df.agg(
        valid.cast("double").alias("n"),
        F.coalesce(F.sum(F.when(_valid(), _correct())), F.lit(0)).cast("double").alias("ok"),
        F.count_if(_failed()).cast("double").alias("failed"),
        total("dist").alias("dist"),
        total("sim").alias("sim"),
        *[c.cast("double").alias(f"j{i}") for i, c in enumerate(judged)],
        F.count("verdict").alias("judged"),
    )
    n = F.col("n")
    metrics = [
        ("n", n, n, None, F.lit(True)),
        ("execution_accuracy", None, F.col("ok"), n, F.lit(True)),
        ("pred_sql_exec_fail_rate", None, F.col("failed"), n, F.lit(True)),
        ("avg_edit_distance", None, F.col("dist"), n, F.lit(True)),
        ("avg_similarity", None, F.col("sim"), n, F.lit(True)),
        ("judge_correct", None, F.col("j0"), n, F.col("judged") > 0),
        ("judge_partial", None, F.col("j1"), n, F.col("judged") > 0),
        ("judge_incorrect", None, F.col("j2"), n, F.col("judged") > 0),
    ]
    rows = []
    for position, (name, value, top, bottom, shown) in enumerate(metrics, start=1):
        value = F.round(F.try_divide(top, bottom), 4) if value is None else value
        rows.append(
            F.struct(
                F.lit(position).alias("ord"),
                F.lit(name).alias("metric"),
                value.alias("value"),
                F.round(top, 4).alias("numerator"),
                (F.lit(None).cast("double") if bottom is None else bottom).alias("denominator"),
                (shown & (n > 0)).alias("shown"),
            )
        )
    rows.append(
        F.struct(
            F.lit(0).alias("ord"),
            F.lit("no valid examples").alias("metric"),
            F.lit(None).cast("double").alias("value"),
            F.lit(None).cast("double").alias("numerator"),
            F.lit(None).cast("double").alias("denominator"),
            (n == 0).alias("shown"),
        )
    )
    return (
        one.select(F.inline(F.array(*rows))).filter("shown").drop("shown").orderBy("ord")
    )


def _number(column: str) -> Column:
    """Shortest text of a rounded number; whole counts without a fraction."""
    value = F.col(column)
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def summary_lines(
    df: DataFrame, parity: bool = False, sql: str | None = None
) -> DataFrame:
    """The text report, line by line: summary, levels, error classes, then verdicts.

    Without a single valid example there are no lines. ``sql`` names the SQL column that
    error texts are classified with.
    """
    rule = "=" * 20
    fraction = F.concat(
        F.lit(" ("), _number("numerator"), F.lit("/"), _number("denominator"), F.lit(")")
    )
    counted = ~F.col("metric").isin("n", "avg_edit_distance", "avg_similarity")
    is_verdict = F.col("metric").startswith("judge_")
    # Verdicts stand below each other at one width.
    label = F.when(is_verdict, F.rpad(F.concat("metric", F.lit(":")), 17, " ")).otherwise(
        F.concat("metric", F.lit(": "))
    )
    summary = eval_summary(df, parity).select(
        F.when(is_verdict, 6).otherwise(1).alias("section"),
        F.col("ord").cast("bigint").alias("k"),
        F.when(F.col("metric") == "n", F.concat(F.lit("n: "), _number("value")))
        .when(F.col("value").isNull(), F.col("metric"))
        .otherwise(
            F.concat(
                label,
                F.col("value").cast("string"),
                F.when(counted, fraction).otherwise(""),
            )
        )
        .alias("line"),
    )
    levels = (
        difficulty_breakdown(df)
        .filter(F.col("position") > 1)
        .select(
            F.lit(3).alias("section"),
            F.col("position").cast("bigint").alias("k"),
            F.concat(
                "level",
                F.lit(": n="), F.col("n").cast("string"),
                F.lit(", accuracy="), F.col("accuracy").cast("string"),
                F.lit(", fail_rate="), F.col("fail_rate").cast("string"),
                F.lit(", avg_edit_distance="), F.col("avg_edit_distance").cast("string"),
            ).alias("line"),
        )
    )
    errors = error_breakdown(df, sql).select(
        F.lit(5).alias("section"),
        (-F.col("n")).alias("k"),
        F.concat("error_class", F.lit(": "), F.col("n").cast("string")).alias("line"),
    )
    fixed = df.sparkSession.createDataFrame(
        [
            (0, 0, rule),
            (0, 1, "EVAL SUMMARY"),
            (0, 2, rule),
            (2, 0, "difficulty_breakdown:"),
            (4, 0, "error_breakdown:"),
        ],
        "section int, k bigint, line string",
    )
    parts = reduce(DataFrame.unionByName, [fixed, summary, levels, errors])
    # A few dozen lines: numbering them in one place is bounded.
    ordered = parts.agg(F.sort_array(F.collect_list(F.struct("section", "k", "line"))).alias("l"))
    written = ordered.filter(F.exists("l", lambda x: x.line.startswith("n: ")))
    return written.select(F.posexplode("l").alias("line_no", "l")).select(
        (F.col("line_no") + 1).alias("line_no"), F.col("l.line").alias("line")
    )


def compare_models(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Accuracy, failure rate and mean distance per model, side by side."""
    scored = df.groupBy("model").agg(
        _rate(F.sum(F.when(_valid(), _correct())), F.count_if(_valid())).alias(
            "execution_accuracy"
        ),
        _rate(F.count_if(_failed()), F.count_if(_valid())).alias("pred_sql_exec_fail_rate"),
        F.round(F.avg(F.when(_valid(), F.col("dist"))), 4).alias("avg_edit_distance"),
    )
    metrics = [c for c in scored.columns if c != "model"]
    long = scored.unpivot(["model"], metrics, "metric", "value")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def parse_verdict(reply: Column | str) -> Column:
    """A judge's reply as ``struct(verdict, reasoning)``.

    Code fences are dropped. A reply that is not one JSON object gives ERROR; an absent
    verdict gives UNKNOWN, an absent reasoning empty text.
    """
    column = F.col(reply) if isinstance(reply, str) else reply
    text = strip(F.regexp_replace(column, "```(?:json)?", ""))
    # Inside brackets trailing text is an error too, and a second object shows.
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one_object = (
        text.startswith("{")
        & boxed.isNotNull()
        & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    )
    keys = F.json_object_keys(text)

    def member(name: str, default: str) -> Column:
        value = F.try_variant_get(boxed, f"$[0].{name}", "string")
        if name == "verdict":  # null is no verdict, as an absent one
            value = F.coalesce(value, F.lit(default))
        return F.when(F.array_contains(keys, name), value).otherwise(default)

    broken = F.struct(
        F.lit("ERROR").alias("verdict"), F.lit("reply is not a JSON object").alias("reasoning")
    )
    parsed = F.struct(
        member("verdict", "UNKNOWN").alias("verdict"), member("reasoning", "").alias("reasoning")
    )
    return F.when(F.coalesce(one_object, F.lit(False)), parsed).otherwise(broken)


def verdict_rates(df: DataFrame, other: str = "separate") -> DataFrame:
    """Counts and shares per verdict.

    ``other`` says where verdicts outside the three known ones go: apart as ERRORS, or
    into INCORRECT.
    """
    if other not in ("separate", "incorrect"):
        raise ValueError(f"other must be 'separate' or 'incorrect', not {other!r}")
    rest = "ERRORS" if other == "separate" else "INCORRECT"
    known = F.col("verdict").isin(VERDICTS)
    label = F.when(known, F.col("verdict")).otherwise(rest)
    labels = [*VERDICTS, *(["ERRORS"] if other == "separate" else [])]
    counts = df.agg(
        F.count("*").alias("n"), *[F.count_if(label == x).alias(x) for x in labels]
    )
    long = counts.unpivot(["n"], labels, "verdict", "count")
    return long.select("verdict", "count", _rate(F.col("count"), F.col("n")).alias("share"))
