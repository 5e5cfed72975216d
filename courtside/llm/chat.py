"""Chat formatting by prefix-target expansion: one example for every assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: <|role|>, a line end, the text, </s>, a line end.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "</s>\n"
# Characters a control string may start with (also [INST] of other templates) and the
# escape character: inside roles and texts each is followed by a backslash.
_SPECIAL = r"([<\[\\|])"


def escape(text: Column) -> Column:
    """``text`` without any control string: every ``< [ | \\`` gets a backslash behind it."""
    return F.regexp_replace(text, _SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    """Undoes :func:`escape` exactly."""
    return F.regexp_replace(text, _SPECIAL + r"\\", "$1")


def prefix_target_examples(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """One row per turn of ``target_role``: all turns before it as context, only it trainable.

    Columns: ``conversation`` (the input's column), ``example`` (from 0), ``text`` (the
    formatted turns up to and with the target), ``loss_start`` and ``loss_length`` (code
    points of the escaped reply inside ``text``: the loss mask), ``is_last`` (``text`` holds
    the whole conversation). Turns after the last reply, and conversations without any, get
    one more row with a mask of length 0, so that no turn is lost.

    Turns are ordered by ``turn``, then role, then text; nulls first, repeated rows stay.
    Null texts and roles count as empty; rows without a conversation id form one
    conversation. An empty table gives no rows; other columns are left out.

    One shuffle, by conversation. A conversation is formatted once, and each example is a
    prefix of that text; the sizes of all examples together grow with the square of a
    conversation's turns, which is what this format asks for.
    """
    rows = turns.select(
        F.col(conversation).alias(conversation),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    gathered = rows.groupBy(conversation).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    pieces = gathered.select(
        conversation,
        F.transform(
            "_turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == target_role).alias("target"),
            ),
        ).alias("_pieces"),
    ).withColumn("_count", F.size("_pieces"))
    ends = F.filter(
        F.sequence(F.lit(1), F.col("_count")),
        lambda i: (i == F.col("_count")) | F.get("_pieces", i - 1)["target"],
    )
    exploded = pieces.select(
        conversation, "_pieces", "_count", F.posexplode(ends).alias("example", "_end")
    )
    target = F.get("_pieces", F.col("_end") - 1)
    context = F.array_join(F.transform(F.slice("_pieces", F.lit(1), F.col("_end") - 1), _turn), "")
    return exploded.select(
        conversation,
        F.col("example").cast("long").alias("example"),
        F.concat(context, _turn(target)).alias("text"),
        (F.length(context) + F.length(target["head"])).cast("long").alias("loss_start"),
        F.when(target["target"], F.length(target["body"]))
        .otherwise(0)
        .cast("long")
        .alias("loss_length"),
        (F.col("_end") == F.col("_count")).alias("is_last"),
    )


def _turn(piece: Column) -> Column:
    return F.concat(piece["head"], piece["body"], F.lit(CLOSE))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of ``role`` and ``text``, unescaped."""
    pieces = F.split(text, CLOSE)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        at = F.locate(MIDDLE, piece)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(piece, at + len(MIDDLE), F.length(piece))).alias("text"),
        )

    return F.transform(whole, parse)


def loss_text(examples: DataFrame) -> Column:
    """The unescaped text under the loss mask of each example."""
    return unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
