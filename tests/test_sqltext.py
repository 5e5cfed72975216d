import random
import re

import pytest
from pyspark.sql import functions as F

from courtside.functions import sqltext as t
from courtside.operators.corpus import label_corpus

TOKEN = r"[a-z_][a-z0-9_]*|\d+|!=|<=|>=|==|[(),;=*<>+-/]"


def one(spark, column, **values):
    schema = ", ".join(f"{name} string" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def python_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("```SQL SELECT a FROM b; ``` done", "SELECT a FROM b;"),
        ("  Answer:  select 1", "select 1"),
        ("A: SQL: SELECT 1", "SELECT 1"),
        ("x\nSELECT a -- c\nfrom b /* q\n */ where c ; d", "SELECT a from b where c ;"),
        ("SELECT ';' FROM t", "SELECT ';"),
        ("xSELECT 1", "SELECT 1"),
        ("WITH q AS (SELECT 1) SELECT 2", "SELECT 1) SELECT 2"),
        ("note; SELECT 1", t.NO_SQL),
        ("SELECTED", t.NO_SQL),
        ("", t.NO_SQL),
        ("none", t.NO_SQL),
    ],
)
def test_clean_sql(spark, reply, want):
    assert one(spark, t.clean_sql("x"), x=reply) == want


def test_tokens(spark):
    text = " SELECT a.b, 0.40 <> 'Zoë' != x_1 <= -3 % "
    assert one(spark, t.sql_tokens("x"), x=text) == re.findall(TOKEN, text.strip().lower())


@pytest.mark.parametrize("words", [6, 120, 900])
def test_token_distance_against_python(spark, words):
    rng = random.Random(words)
    pool = [f"w{i}" for i in range(words)]

    def text():
        return " ".join(rng.choice(pool) for _ in range(rng.randint(0, words)))

    pairs = [(i, text(), text()) for i in range(12)] + [(98, "", ""), (99, "a", "")]
    df = spark.createDataFrame(pairs, "i int, a string, b string").select(
        "i", "a", "b", t.sql_tokens("a").alias("ta"), t.sql_tokens("b").alias("tb")
    )
    rows = df.select(
        "*", t.token_distance("ta", "tb").alias("d"), t.token_similarity("ta", "tb").alias("s")
    ).collect()
    for r in rows:
        want = python_distance(r.a.split(), r.b.split())
        assert r.d == want
        assert r.s == pytest.approx(1 - want / max(len(r.a.split()), len(r.b.split()), 1))


@pytest.mark.parametrize("limit", [0, 10, 400])
def test_token_distance_beyond_the_characters(spark, monkeypatch, limit):
    # No pair may fail: with too few characters the table is filled row by row.
    monkeypatch.setattr(t, "_MAX_VOCABULARY", limit)
    monkeypatch.setattr(t, "_FIRST_CODE", min(limit, 8))
    rng = random.Random(limit)

    def tokens():
        return [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 30))]

    pairs = [(tokens(), tokens()) for _ in range(20)] + [(["a"], []), ([], ["a"]), ([], [])]
    pairs += [(["x", *p, "y"], ["x", *q, "y"]) for p, q in pairs[:6]]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", t.token_distance("a", "b").alias("d")).collect():
        assert r.d == python_distance(r.a, r.b)


def test_wide_codes_are_one_character_each(spark):
    positions = [1, 2, 0xD700, 0xD701, 60_000, 1_000_000]
    df = spark.createDataFrame([(p,) for p in positions], "p int")
    coded = [r[0] for r in df.select(t._wide_code(F.col("p").cast("bigint"))).collect()]
    assert all(len(c) == 1 for c in coded) and len(set(coded)) == len(positions)


def test_feature_count_and_conditions(spark):
    sql = (
        "SELECT a FROM t JOIN u ON x JOIN v ON y WHERE a = 1 AND b BETWEEN 1 AND 2 OR c IN "
        "(SELECT MAX(z) FROM w) GROUP BY a HAVING b > 1 AND c > 2 ORDER BY a LIMIT 3"
    )
    assert one(spark, t.sql_feature_count("x"), x=sql) == 2 + 2 + 2 + 1 + 1 + 1 + 2 + 1
    # HAVING does not end the clause only because GROUP BY came first.
    assert one(spark, t.count_conditions("x"), x=sql) == 4
    broken = sql.replace(" ", "\n")
    assert one(spark, t.sql_feature_count("x"), x=broken) == 0
    assert one(spark, t.count_conditions("x"), x=broken) == 0
    assert one(spark, t.count_conditions("x"), x="s where a having b and c") == 2
    assert one(spark, t.sql_feature_count("x"), x="select max(a), sum(b) from t") == 3


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("top scorer", "comparison"),  # "or" inside "scorer"
        ("players by country", "count"),  # "count" inside "country"
        ("has he improved", "trend"),
        (" Top 5 men", "ranking"),
        ("who is he", "lookup"),
        ("which team is it", "lookup"),
        ("show me all", "list"),
        ("hm", "other"),
        (None, "other"),
    ],
)
def test_question_type(spark, question, want):
    assert one(spark, t.question_type("x"), x=question) == want


def test_word_count(spark):
    df = spark.createDataFrame([(0, " a  b\tc "), (1, ""), (2, None), (3, "x")], "i int, x string")
    rows = df.select("i", t.word_count("x").alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [3, 0, 1, 1]


def test_difficulty_levels(spark):
    rows = [
        ("list", "SELECT 1", "easy"),
        ("the best men in the west", "SELECT a FROM t WHERE b = 1 ORDER BY c LIMIT 5", "medium"),
        (
            "compare the best over time for all of the men in the whole wide league",
            "SELECT a FROM t JOIN u ON x WHERE b AND c AND d GROUP BY e LIMIT 1",
            "hard",
        ),
    ]
    df = spark.createDataFrame(rows, "input string, output string, want string")
    labelled = label_corpus(df)
    got = labelled.withColumn("again", t.difficulty("input", "output")).collect()
    assert all(r.difficulty == r.want == r.again for r in got)


@pytest.mark.parametrize(
    ("message", "sql", "want"),
    [
        ("", "", "unknown"),
        (None, "", "unknown"),
        ('syntax error at or near "x"', "", "syntax_error"),
        ("invalid input syntax for type integer", "", "syntax_error"),
        ('relation "a" does not exist', "", "missing_table"),
        ('column "a" does not exist', "", "missing_column"),
        ('column reference "a" is ambiguous', "", "ambiguous_column"),
        ('column "a" must appear in the GROUP BY clause', "", "group_by_error"),
        ("aggregate functions are not allowed in GROUP BY", "", "group_by_error"),
        ('missing FROM-clause entry for table "z"', "", "join_error"),
        ("bad FROM-clause", "a JOIN b", "join_error"),
        ("bad FROM-clause", "a", "other_execution_error"),
        ("operator does not exist: text = int", "", "type_mismatch"),
        ("function f() does not exist", "", "function_error"),
        ("permission denied for x", "", "permission_error"),
        ("statement timeout", "", "timeout_or_cancelled"),
        ("odd", "", "other_execution_error"),
    ],
)
def test_classify_sql_error(spark, message, sql, want):
    assert one(spark, t.classify_sql_error("m", "s"), m=message, s=sql) == want


def test_classify_condition(spark):
    names = {
        "UNRESOLVED_COLUMN.WITH_SUGGESTION": "missing_column",
        "DATATYPE_MISMATCH.CAST_WITHOUT_SUGGESTION": "type_mismatch",
        "TABLE_OR_VIEW_NOT_FOUND": "missing_table",
        "DIVIDE_BY_ZERO": "other_execution_error",
        "": "unknown",
    }
    for name, want in names.items():
        assert one(spark, t.classify_condition("x"), x=name) == want
    joined = t.classify_condition("x", F.lit(True))
    assert one(spark, joined, x="UNRESOLVED_COLUMN.WITHOUT_SUGGESTION") == "join_error"
