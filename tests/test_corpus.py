import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from courtside.operators import corpus as c

CHAT = "conv int, turn int, role string, text string"


def python_chat(messages, prompt):
    """The transcript format, written out."""
    messages = sorted(messages)
    system = ""
    if messages[0][1] == "system":
        system, messages = messages[0][2].strip(), messages[1:]
    out = (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
        "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"
        f"{system}<|eot_id|>"
    )
    for _, role, text in messages:
        out += f"<|start_header_id|>{role}<|end_header_id|>\n\n{text.strip()}<|eot_id|>"
    return out + ("<|start_header_id|>assistant<|end_header_id|>\n\n" if prompt else "")


CONVERSATIONS = {
    1: [(0, "system", " be brief "), (1, "user", "hi\n"), (2, "assistant", " yes")],
    2: [(3, "user", "q"), (9, "assistant", "a"), (11, "system", "late")],
    3: [(5, "system", "alone")],
    4: [(i, ("user", "assistant")[i % 2], f"t{i}") for i in range(23)],
    5: [(i, ("user", "assistant")[i % 2], f"t{i}") for i in range(1020, 1031)],
    6: [(i, ("user", "assistant")[i % 2], f"t{i}") for i in range(5000)],
}


@pytest.mark.parametrize("prompt", [True, False])
def test_render_chat(spark, prompt):
    rows = [(conv, *m) for conv, messages in CONVERSATIONS.items() for m in messages]
    df = spark.createDataFrame(rows, CHAT)
    made = c.render_chat(
        df, "conv", "turn", "role", "text", add_generation_prompt=prompt
    ).collect()
    assert sorted(r.conv for r in made) == sorted(CONVERSATIONS)
    for r in made:
        assert r.transcript == python_chat(CONVERSATIONS[r.conv], prompt)


def test_render_chat_shuffles_once(spark):
    df = spark.createDataFrame([(1, 0, "user", "q")], CHAT)
    plan = c.render_chat(df, "conv", "turn", "role", "text")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1


def test_sft_example(spark):
    df = spark.createDataFrame([(" who? ", "SELECT 1")], "input string, output string")
    row = c.sft_examples(df).first()
    messages = [(0, "system", c.SQL_EXPERT), (1, "user", " who? ")]
    assert row.prompt == python_chat(messages, True)
    assert row.full_text == row.prompt + "SELECT 1<|eot_id|>"


def test_seq2seq(spark):
    df = spark.createDataFrame([("q", "s")], "input string, output string")
    row = c.seq2seq_examples(df).first()
    assert (row.source, row.target) == ("translate English to SQL: q", "s")


@pytest.mark.parametrize("ids", [[], [5, 6], [5, 0, 6, 7], [1, 2, 3, 4, 5, 6, 7]])
@pytest.mark.parametrize("prompt_len", [None, 0, 2, 9])
def test_pad_and_mask(spark, ids, prompt_len):
    df = spark.createDataFrame([(ids, prompt_len)], "ids array<int>, n int")
    row = df.select(
        c.pad_and_mask("ids", None if prompt_len is None else "n", 0, 5).alias("p")
    ).first()[0]
    padded = (ids + [0] * 5)[:5]
    start = prompt_len or 0
    labels = [-100 if i < start or x == 0 else x for i, x in enumerate(padded)]
    assert (row.input_ids, row.labels) == (padded, labels)


@pytest.mark.parametrize(
    ("question", "sql", "preview", "error"),
    [
        ("q", "SELECT 1", "(no rows returned)", ""),
        ("q", "SELECT 1", "a | b\n----\n1 | 2\n", None),
        ("q", "SELECT 1", "ignored", "boom\nat line 1"),
        ("q", "SELECT 1\n            FROM t", "(no rows returned)", ""),
        ("q\n    deep\n\n\t\nline", "SELECT 1", "(no rows returned)", ""),
    ],
)
def test_judge_prompt_is_dedented_as_a_whole(spark, question, sql, preview, error):
    df = spark.createDataFrame(
        [(question, sql, preview, error)], "question string, sql string, preview string, error string"
    )
    shown = f"SQL ERROR:\n{error}" if error else preview
    want = textwrap.dedent(
        f"""
        Natural-language question:
        {question}

        SQL query:
        {sql}

        Query result:
        {shown} """
    ).strip()
    assert c.judge_prompt(df).first().prompt == want


@pytest.mark.parametrize("end", ["\r", "\x85", "\u2028", "\n", "\x0b", "\u00a0", " \t"])
def test_dedent_of_odd_blanks(spark, end):
    """Against the patterns that the trims stand for."""
    texts = [f"  a\n   {end}\n  b {end}", f"{end} x", f"   {end}   ", f"\n\t {end}\n   c\n {end}d\n", end]
    for text in texts:
        lines = [re.sub(r"^[ \t]+(?=[\r\x85\u2028\u2029]?\Z)", "", x) for x in text.split("\n")]
        margins = [len(x) - len(x.lstrip(" ")) for x in lines if x != ""]
        want = "\n".join(x[min(margins) :] for x in lines).strip() if margins else ""
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(c._dedent(F.col("t"))).first()[0] == want


def test_prompt_of_many_lines_takes_linear_time(spark):
    text = "\n".join(f"    line {i}" for i in range(8000))
    schema = "question string, sql string, preview string, error string"
    df = spark.createDataFrame([(text, "SELECT 1", "p", "")], schema)
    began = time.monotonic()
    prompt = c.judge_prompt(df).first().prompt
    assert time.monotonic() - began < 10
    assert "\nline 7999\n" in prompt


def test_predictor_is_made_once_per_partition(spark):
    def make():
        calls = []

        def predict(questions):
            calls.append(1)
            return [f"SELECT {len(calls)}; -- {q}" for q in questions]

        return predict

    df = spark.range(0, 40, 1, 2).select(
        F.col("id").alias("example_id"), F.col("id").cast("string").alias("question")
    )
    rows = c.predict_sql(df, make).collect()
    assert len(rows) == 40 and {r.pred_sql for r in rows} == {"SELECT 1;"}
