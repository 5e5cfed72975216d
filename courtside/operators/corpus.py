"""Preparing question/SQL corpora: labels, splits, prompts, token labels, predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.cleaning import strip, strip_plain
from courtside.functions.sqltext import (
    clean_sql,
    difficulty_label,
    difficulty_score,
    question_text,
    question_type,
    word_count,
)
from courtside.operators.keys import bucket_offsets, hash_order

# ---------------------------------------------------------------------------
# Prompt texts and special tokens.
SEQ2SEQ_PREFIX = "translate English to SQL: "
SQL_EXPERT = (
    "You are a SQL expert. Convert the user's natural language question into a valid SQL "
    "query. Output only the SQL query with no explanation."
)
BEGIN = "<|begin_of_text|>"
END_TURN = "<|eot_id|>"
HEADER = ("<|start_header_id|>", "<|end_header_id|>\n\n")
CUTOFF_LINE = "Cutting Knowledge Date: December 2023\n"
TODAY = "26 Jul 2024"
IGNORED_LABEL = -100
# ---------------------------------------------------------------------------


def label_corpus(df: DataFrame, question: str = "input", sql: str = "output") -> DataFrame:
    """Add ``word_count``, ``query_type`` and ``difficulty``."""
    # The cleaned question and the score are columns of their own, so that the many
    # rules on them do not each clean the text again.
    prepared = df.withColumn("_q", question_text(question))
    scored = prepared.withColumn("_score", difficulty_score("_q", sql, prepared=True))
    return scored.withColumns(
        {
            "word_count": word_count(question),
            "query_type": question_type("_q", prepared=True),
            "difficulty": difficulty_label("_score"),
        }
    ).drop("_q", "_score")


def label_counts(labelled: DataFrame) -> DataFrame:
    """Examples per difficulty and per question type, most frequent first."""
    long = labelled.select(
        F.explode(
            F.array(
                F.struct(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("label")),
                F.struct(F.lit("query_type").alias("kind"), F.col("query_type").alias("label")),
            )
        ).alias("x")
    ).select("x.kind", "x.label")
    counts = long.groupBy("kind", "label").agg(F.count("*").alias("n"))
    return counts.orderBy("kind", F.desc("n"), "label")


def split_corpus(
    df: DataFrame, key: str | Sequence[str], seed: int = 20, hex_digits: int = 4
) -> DataFrame:
    """Add ``split``: 80 % train, 10 % val, 10 % test, in exact sizes.

    ``key`` identifies a row. Rows stand in the order of a seeded hash; the held-out
    fifth rounds up and its test half too. Hash buckets that lie wholly on one side
    of a cut take their split from the bucket table (at most ``16 ** hex_digits``
    rows); only the one or two buckets a cut runs through are numbered row by row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_hash", hash_order(keys, str(seed)))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, hex_digits))
    held_out = F.ceil(F.lit(0.2) * F.col("_total"))
    test = F.ceil(F.lit(0.5) * held_out)

    def place(first: Column, last: Column) -> Column:
        return (
            F.when(last <= test, "test")
            .when((first > test) & (last <= held_out), "val")
            .when(first > held_out, "train")
        )

    cuts = bucket_offsets(hashed, "_bucket").select(
        "_bucket",
        "_before",
        held_out.alias("_held_out"),
        test.alias("_test"),
        place(F.col("_before") + 1, F.col("_before") + F.col("_size")).alias("split"),
    )
    held_out, test = F.col("_held_out"), F.col("_test")
    placed = hashed.join(F.broadcast(cuts), "_bucket")
    whole = placed.filter(F.col("split").isNotNull())
    position = F.col("_before") + F.row_number().over(
        Window.partitionBy("_bucket").orderBy("_hash", *keys)
    )
    cut = placed.filter(F.col("split").isNull()).withColumn("_pos", position)
    cut = cut.withColumn("split", place(F.col("_pos"), F.col("_pos")))
    columns = [*df.columns, "split"]
    return whole.select(*columns).unionByName(cut.select(*columns))


def seq2seq_examples(
    df: DataFrame, question: str = "input", sql: str = "output"
) -> DataFrame:
    """``source``/``target`` texts for a sequence-to-sequence model."""
    return df.select(
        "*",
        F.concat(F.lit(SEQ2SEQ_PREFIX), F.col(question)).alias("source"),
        F.col(sql).alias("target"),
    )


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEADER[0]), role, F.lit(HEADER[1]), strip(text), F.lit(END_TURN))


def _system_block(text: Column, today: str) -> Column:
    return F.concat(
        F.lit(BEGIN + HEADER[0] + "system" + HEADER[1] + CUTOFF_LINE),
        F.lit(f"Today Date: {today}\n\n"),
        strip(text),
        F.lit(END_TURN),
    )


ASSISTANT_HEADER = HEADER[0] + "assistant" + HEADER[1]


def render_chat(
    df: DataFrame,
    conv: str,
    turn: str,
    role: str,
    text: str,
    add_generation_prompt: bool = False,
    today: str = TODAY,
) -> DataFrame:
    """Conversations as model transcripts: ``(conv, transcript)``, one row each.

    A system block opens every transcript; it holds the first message if that is a
    system one. ``turn`` numbers are unique within a conversation. A transcript is one
    value, so a conversation's rendered turns meet in one task, after the one shuffle.
    """
    rendered = df.select(
        conv,
        F.col(turn).alias("_t"),
        F.col(role).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    gathered = rendered.groupBy(conv).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("_t"), _turn(F.col("_role"), F.col("_text")).alias("x")))
        ).alias("_turns"),
        F.min_by(F.struct("_role", "_text"), "_t").alias("_first"),
    )
    takes_system = F.col("_first._role").eqNullSafe("system")
    opening = _system_block(F.when(takes_system, F.col("_first._text")).otherwise(""), today)
    rest = F.slice("_turns", F.when(takes_system, 2).otherwise(1), F.size("_turns"))
    body = F.array_join(F.transform(rest, lambda m: m.x), "")
    closing = F.lit(ASSISTANT_HEADER if add_generation_prompt else "")
    return gathered.select(conv, F.concat(opening, body, closing).alias("transcript"))


def chat_prompt(
    question: Column | str, system: str = SQL_EXPERT, today: str = TODAY
) -> Column:
    """A one-question prompt that ends with the assistant's header."""
    asked = F.col(question) if isinstance(question, str) else question
    return F.concat(
        _system_block(F.lit(system), today),
        _turn(F.lit("user"), asked),
        F.lit(ASSISTANT_HEADER),
    )


def sft_examples(df: DataFrame, question: str = "input", sql: str = "output") -> DataFrame:
    """``prompt`` and ``full_text`` (prompt, answer, end token), one row per pair."""
    prompt = chat_prompt(question)
    return df.select("*", prompt.alias("prompt")).withColumn(
        "full_text", F.concat("prompt", F.col(sql), F.lit(END_TURN))
    )


def pad_and_mask(
    ids: Column | str, prompt_len: Column | str | None, pad_id: int, max_len: int
) -> Column:
    """``struct(input_ids, labels)`` of length ``max_len``.

    Labels repeat the ids, with the ignored label at prompt positions and wherever the
    id is the pad id. With ``prompt_len`` None only pads are masked.
    """
    column = F.col(ids) if isinstance(ids, str) else ids
    cut = F.slice(column, 1, max_len)
    missing = F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))
    padded = F.concat(cut, F.array_repeat(F.lit(pad_id), missing))
    if prompt_len is None:
        masked = F.transform(
            padded, lambda x: F.when(x == pad_id, IGNORED_LABEL).otherwise(x)
        )
    else:
        prompt = F.col(prompt_len) if isinstance(prompt_len, str) else prompt_len
        masked = F.transform(
            padded,
            lambda x, i: F.when((i < prompt) | (x == pad_id), IGNORED_LABEL).otherwise(x),
        )
    return F.struct(padded.alias("input_ids"), masked.alias("labels"))


Predictor = Callable[[Sequence[str]], Sequence[str]]


def predict_sql(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    key: str = "example_id",
    question: str = "question",
    clean: bool = True,
) -> DataFrame:
    """Run a batch predictor over the questions: ``(key, question, reply, pred_sql)``.

    ``make_predictor`` is called once per partition; the predictor gets lists of
    questions and returns as many replies.
    """
    asked = df.select(key, question)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = None
        for batch in batches:
            if predictor is None:
                predictor = make_predictor()
            yield batch.assign(reply=list(predictor(batch[question].tolist())))

    replies = asked.mapInPandas(run, f"{key} {key_type}, {question} string, reply string")
    sql = clean_sql("reply") if clean else strip("reply")
    return replies.withColumn("pred_sql", sql)


def _dedent(text: Column) -> Column:
    """Drop the margin all non-blank lines share, then strip.

    Lines and margin are bound by a ``transform`` over one element each: inside the cut of a
    line they would be worked out again for every line.
    """

    def line(x: Column) -> Column:
        # Blanks before the end of a line go, also before an ending that is no line feed.
        bare = F.ltrim(x, F.lit(" \t"))
        return F.when(bare.isin("", "\r", "\x85", "\u2028", "\u2029"), bare).otherwise(x)

    lines = F.transform(F.split(text, "\n"), line)

    def margin(every: Column) -> Column:
        filled = F.filter(every, lambda x: x != "")
        return F.array_min(F.transform(filled, lambda x: F.length(x) - F.length(F.ltrim(x))))

    measured = F.transform(
        F.array(lines), lambda every: F.struct(every.alias("lines"), margin(every).alias("margin"))
    )
    cut = F.transform(
        measured,
        lambda m: F.array_join(
            F.transform(m["lines"], lambda x: F.substring(x, m["margin"] + 1, F.length(x))), "\n"
        ),
    )
    return F.transform(F.transform(cut, lambda x: F.trim(x, F.lit(" \n\t\r"))), strip_plain)[0]


def judge_prompt(
    df: DataFrame,
    question: str = "question",
    sql: str = "sql",
    result: str = "preview",
    error: str = "error",
) -> DataFrame:
    """Add ``prompt``: question, SQL and result (or error) as one text block.

    The block is written with an indent of eight and dedented as a whole, so values
    of several lines keep the indent of the lines around them.
    """
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    shown = F.when(failed, F.concat(F.lit("SQL ERROR:\n"), F.col(error))).otherwise(
        F.col(result)
    )
    indent = "\n        "
    block = F.concat(
        F.lit(f"{indent}Natural-language question:{indent}"),
        F.col(question),
        F.lit(f"\n{indent}SQL query:{indent}"),
        F.col(sql),
        F.lit(f"\n{indent}Query result:{indent}"),
        shown,
        F.lit(" "),
    )
    return df.withColumn("prompt", _dedent(block))
