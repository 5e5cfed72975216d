"""Splits, prompts, transcripts, token labels and batch prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.catalogue import query
from courtside.catalogue.text import _TRIMMED
from courtside.fixtures import Views, with_views
from courtside.operators import corpus


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    with_views(
        "sql_pairs",
        placed="""SELECT example_id, row_number() OVER (
      ORDER BY md5(concat_ws('|', '20', CAST(example_id AS varchar))), example_id) AS pos,
    count(*) OVER () AS n FROM sql_pairs""",
        sized="SELECT *, ceil(0.2::double * n) AS held_out FROM placed",
    )
    + """SELECT example_id, CASE WHEN pos <= ceil(0.5::double * held_out) THEN 'test'
  WHEN pos <= held_out THEN 'val' ELSE 'train' END AS split FROM sized"""
)
def split_80_10_10(v: Views) -> DataFrame:
    split = corpus.split_corpus(v["sql_pairs"], "example_id")
    return split.select("example_id", "split")


@query(
    with_views("sql_pairs")
    + f"""SELECT example_id, concat({_quoted(corpus.SEQ2SEQ_PREFIX)}, question) AS source,
  gold_sql AS target FROM sql_pairs"""
)
def t5_prompt(v: Views) -> DataFrame:
    examples = corpus.seq2seq_examples(v["sql_pairs"], "question", "gold_sql")
    return examples.select("example_id", "source", "target")


_SYSTEM_OPENING = _quoted(
    corpus.BEGIN
    + corpus.HEADER[0]
    + "system"
    + corpus.HEADER[1]
    + corpus.CUTOFF_LINE
    + f"Today Date: {corpus.TODAY}\n\n"
)
_END = _quoted(corpus.END_TURN)


def _turn_sql(role: str, text: str) -> str:
    opening, closing = map(_quoted, corpus.HEADER)
    return f"concat({opening}, {role}, {closing}, {_TRIMMED.format(text)}, {_END})"


@query(
    "WITH marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn "
    "FROM conversations), "
    "takes AS (SELECT *, rn = 1 AND role = 'system' AS is_system FROM marked) "
    f"""SELECT conv_id, concat({_SYSTEM_OPENING},
  coalesce(max({_TRIMMED.format("text")}) FILTER (WHERE is_system), ''), {_END},
  coalesce(string_agg({_turn_sql("role", "text")}, '' ORDER BY turn)
    FILTER (WHERE NOT is_system), ''),
  {_quoted(corpus.ASSISTANT_HEADER)}) AS transcript FROM takes GROUP BY conv_id"""
)
def chat_transcript(v: Views) -> DataFrame:
    turns = v.base("conversations")
    return corpus.render_chat(
        turns, "conv_id", "turn", "role", "text", add_generation_prompt=True
    )


@query(
    with_views("sql_pairs")
    + f"""SELECT example_id, concat({_SYSTEM_OPENING}, {_quoted(corpus.SQL_EXPERT)}, {_END},
  {_turn_sql("'user'", "question")}, {_quoted(corpus.ASSISTANT_HEADER)}, gold_sql, {_END})
  AS full_text FROM sql_pairs"""
)
def sft_example(v: Views) -> DataFrame:
    examples = corpus.sft_examples(v["sql_pairs"], "question", "gold_sql")
    return examples.select("example_id", "full_text")


# Stand-in token ids: a turn's word lengths. The pad id, 3, also occurs as a token.
_PAD, _LENGTH = 3, 128
_IDS_SQL = f"""SELECT conv_id, turn, n, list_concat(ids, list_transform(
    range(greatest({_LENGTH} - len(ids), 0)), lambda i: {_PAD})) AS ids
FROM (SELECT conv_id, turn, 4 + turn AS n, list_transform(string_split(text, ' '),
    lambda w: CAST(length(w) AS bigint))[1:{_LENGTH}] AS ids FROM conversations) x"""


def _joined(list_sql: str) -> str:
    return f"array_to_string({list_sql}, ' ')"


@query(
    f"""WITH padded AS ({_IDS_SQL})
SELECT conv_id, turn, {_joined("ids")} AS input_ids,
  {_joined(f"list_transform(ids, lambda x, i: CASE WHEN i <= n OR x = {_PAD} THEN -100 ELSE x END)")}
    AS causal_labels,
  {_joined(f"list_transform(ids, lambda x: CASE WHEN x = {_PAD} THEN -100 ELSE x END)")}
    AS seq2seq_labels FROM padded"""
)
def pad_and_mask(v: Views) -> DataFrame:
    words = F.split("text", " ")
    tokens = v.base("conversations").select(
        "conv_id",
        "turn",
        F.transform(words, lambda w: F.length(w)).alias("ids"),
        (F.col("turn") + 4).cast("int").alias("prompt_len"),
    )
    causal = corpus.pad_and_mask("ids", "prompt_len", _PAD, _LENGTH)
    seq2seq = corpus.pad_and_mask("ids", None, _PAD, _LENGTH)
    made = tokens.select("conv_id", "turn", causal.alias("c"), seq2seq.alias("s"))

    def text(column: str) -> Column:
        return F.array_join(F.col(column).cast("array<string>"), " ")

    return made.select(
        "conv_id",
        "turn",
        text("c.input_ids").alias("input_ids"),
        text("c.labels").alias("causal_labels"),
        text("s.labels").alias("seq2seq_labels"),
    )


def _word_counter() -> corpus.Predictor:
    """A predictor that answers with the number of the question's words."""

    def predict(questions: Sequence[str]) -> list[str]:
        return [f"A: SELECT {len(q.split())} -- words; done" for q in questions]

    return predict


@query(
    with_views("sql_pairs")
    + """SELECT example_id, concat('SELECT ', len(string_split(question, ' '))) AS pred_sql
FROM sql_pairs"""
)
def batch_predict(v: Views) -> DataFrame:
    predicted = corpus.predict_sql(v["sql_pairs"], _word_counter)
    return predicted.select("example_id", "pred_sql")
