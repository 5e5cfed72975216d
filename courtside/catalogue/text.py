"""Operators on SQL text and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.catalogue import number, query
from courtside.fixtures import Views, with_views
from courtside.functions import sqltext
from courtside.operators.corpus import label_corpus as label
from courtside.operators.corpus import label_counts

# DuckDB restatements. Patterns are the same; the SQL text in the fixtures is ASCII.
_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def clean_sql_text(reply: str) -> str:
    """SQL for ``clean_sql`` of a text expression."""
    text = f"regexp_replace({reply}, '(?i)```sql', '', 'g')"
    text = _TRIMMED.format(f"replace({text}, '```', '')")
    text = rf"regexp_replace({text}, '(?i)^(A:|Answer:|SQL:|Query:)\s*', '')"
    text = rf"regexp_replace({text}, '--[^\n]*', '', 'g')"
    text = rf"regexp_replace({text}, '(?s)/\*.*?\*/', '', 'g')"
    text = _TRIMMED.format(rf"regexp_replace({text}, '\s+', ' ', 'g')")
    first = f"regexp_extract({text}, '^[^;]*;?')"
    found = rf"regexp_extract({first}, '(?is)SELECT\b.*')"
    return f"coalesce(nullif({_TRIMMED.format(found)}, ''), '{sqltext.NO_SQL}')"


def tokens_text(sql: str) -> str:
    trimmed = _TRIMMED.format(sql)
    pattern = r"[a-z_][a-z0-9_]*|\d+|!=|<=|>=|==|[(),;=*<>+-/]"
    return f"regexp_extract_all(lower({trimmed}), '{pattern}')"


def distances_text(source: str, key: str, gold: str, pred: str) -> dict[str, str]:
    """Views ``toks`` and ``dists``: token distances of a table's gold and predicted SQL.

    DuckDB's levenshtein counts bytes, so tokens become single-byte characters.
    """
    coded = "list_transform({}, lambda t: chr((list_position(voc, t) + 32)::int))"
    text = "coalesce(list_aggregate(" + coded + ", 'string_agg', ''), '')"
    return {
        "toks": f"""SELECT {key}, g, p, list_distinct(list_concat(g, p)) AS voc
FROM (SELECT {key}, {tokens_text(gold)} AS g, {tokens_text(pred)} AS p FROM {source}) x""",
        "dists": f"""SELECT {key}, len(g) AS ng, len(p) AS np,
  CAST(levenshtein({text.format("g")}, {text.format("p")}) AS int) AS dist FROM toks""",
    }


SIMILARITY = "round(1.0::double - dist::double / greatest(ng, np, 1), 4)"
_TOKENS = with_views(
    "sql_pairs", **distances_text("sql_pairs", "example_id", "gold_sql", clean_sql_text("reply"))
)


@query(
    with_views("sql_pairs")
    + f"SELECT example_id, {clean_sql_text('reply')} AS pred_sql FROM sql_pairs"
)
def clean_sql(v: Views) -> DataFrame:
    return v["sql_pairs"].select("example_id", sqltext.clean_sql("reply").alias("pred_sql"))


@query(
    with_views("sql_pairs")
    + f"""SELECT example_id, array_to_string({tokens_text("gold_sql")}, ' ') AS tokens,
  CAST(len({tokens_text("reply")}) AS int) AS reply_tokens FROM sql_pairs"""
)
def sql_tokenize(v: Views) -> DataFrame:
    return v["sql_pairs"].select(
        "example_id",
        F.array_join(sqltext.sql_tokens("gold_sql"), " ").alias("tokens"),
        F.size(sqltext.sql_tokens("reply")).alias("reply_tokens"),
    )


def _tokenised(v: Views) -> DataFrame:
    return v["sql_pairs"].select(
        "example_id",
        sqltext.sql_tokens("gold_sql").alias("g"),
        sqltext.sql_tokens(sqltext.clean_sql("reply")).alias("p"),
    )


@query(_TOKENS + "SELECT example_id, dist FROM dists")
def token_edit_distance(v: Views) -> DataFrame:
    return _tokenised(v).select("example_id", sqltext.token_distance("g", "p").alias("dist"))


@query(_TOKENS + f"SELECT example_id, {SIMILARITY} AS sim FROM dists")
def edit_similarity(v: Views) -> DataFrame:
    similarity = sqltext.token_similarity("g", "p")
    return _tokenised(v).select("example_id", number(similarity, "sim"))


@query(
    with_views("sql_pairs")
    + """SELECT example_id, CAST(levenshtein(gold_sql, reply) AS int) AS dist FROM sql_pairs"""
)
def char_edit_distance(v: Views) -> DataFrame:
    distance = sqltext.char_distance("gold_sql", "reply")
    return v["sql_pairs"].select("example_id", distance.alias("dist"))


# The whole table of distances, a row of it per token.
_PROSE = (
    with_views("text_pairs")
    + f"""SELECT conv_id, turn, CAST(line[len(p) + 1] AS int) AS dist,
  round(1.0 - line[len(p) + 1] / greatest(len(g), len(p), 1), 4) AS sim
FROM (
  WITH RECURSIVE steps AS (
    SELECT conv_id, turn, {tokens_text("gold")} AS g, {tokens_text("pred")} AS p, 0 AS i,
      range(0, len({tokens_text("pred")}) + 1) AS line FROM text_pairs
    UNION ALL
    SELECT conv_id, turn, g, p, i + 1, list_transform(range(1, len(p) + 2), lambda j:
      j - 1 + list_min(list_transform(range(1, j + 1), lambda k: best[k] - k + 1)))
    FROM (SELECT *, list_transform(range(1, len(p) + 2), lambda j: CASE WHEN j = 1 THEN i + 1
      ELSE least(line[j] + 1, line[j - 1] + CASE WHEN g[i + 1] = p[j - 1] THEN 0 ELSE 1 END)
      END) AS best FROM steps WHERE i < len(g))
  ) SELECT * FROM steps WHERE i = len(g)
)"""
)


@query(_PROSE)
def prose_token_distance(v: Views) -> DataFrame:
    """Whole prose turns, beyond ASCII and beyond one-byte vocabularies."""
    pairs = v["text_pairs"].select(
        "conv_id",
        "turn",
        sqltext.sql_tokens("gold").alias("g"),
        sqltext.sql_tokens("pred").alias("p"),
    )
    distance = pairs.withColumn("dist", sqltext.token_distance("g", "p"))
    return distance.select(
        "conv_id",
        "turn",
        "dist",
        number(sqltext.token_similarity("g", "p", F.col("dist")), "sim"),
    )


def _count(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


def features_text(sql: str) -> str:
    s = f"lower({sql})"

    def has(*words: str) -> str:
        return "(" + " OR ".join(f"contains({s}, '{w}')" for w in words) + ")"

    def points(n: int, *words: str) -> str:
        return f"CASE WHEN {has(*words)} THEN {n} ELSE 0 END"

    terms = [
        _count(s, " join "),
        points(2, " group by "),
        points(2, " having "),
        points(1, " order by "),
        points(1, " limit "),
        points(1, " where "),
        points(2, " in (", "select max", "select min"),
        points(1, " avg(", " sum(", " count(", " max(", " min("),
    ]
    return f"CAST({' + '.join(terms)} AS int)"


def conditions_text(sql: str) -> str:
    s = f"lower({sql})"
    clause = f"substr({s}, strpos({s}, ' where ') + 7)"
    for end in (" group by ", " order by ", " limit "):
        clause = f"string_split({clause}, '{end}')[1]"
    found = f"{_count(clause, ' and ')} + {_count(clause, ' or ')} + 1"
    return f"CAST(CASE WHEN contains({s}, ' where ') THEN {found} ELSE 0 END AS int)"


# Statements with every clause the features look at, next to the corpus's own.
_STATEMENTS_SQL = """SELECT example_id, gold_sql AS s FROM sql_pairs
UNION ALL SELECT example_id, reply FROM sql_pairs
UNION ALL SELECT example_id, concat('SELECT t.a, SUM(b) FROM t JOIN u ON t.k = u.k JOIN w ON ',
  'u.k = w.k WHERE t.a = ', example_id, ' AND t.b BETWEEN 1 AND 2 OR t.c IN (SELECT MAX(c) ',
  'FROM v WHERE d = 1) GROUP BY t.a HAVING SUM(b) > 3 ORDER BY 2 LIMIT 4') FROM sql_pairs"""


def _statements(v: Views) -> DataFrame:
    rich = F.concat(
        F.lit("SELECT t.a, SUM(b) FROM t JOIN u ON t.k = u.k JOIN w ON u.k = w.k WHERE t.a = "),
        F.col("example_id").cast("string"),
        F.lit(
            " AND t.b BETWEEN 1 AND 2 OR t.c IN (SELECT MAX(c) FROM v WHERE d = 1) "
            "GROUP BY t.a HAVING SUM(b) > 3 ORDER BY 2 LIMIT 4"
        ),
    )
    return v["sql_pairs"].select(
        "example_id", F.explode(F.array("gold_sql", "reply", rich)).alias("s")
    )


@query(
    with_views("sql_pairs", statements=_STATEMENTS_SQL)
    + f"SELECT example_id, s, {features_text('s')} AS features FROM statements"
)
def sql_feature_count(v: Views) -> DataFrame:
    return _statements(v).withColumn("features", sqltext.sql_feature_count("s"))


@query(
    with_views("sql_pairs", statements=_STATEMENTS_SQL)
    + f"SELECT example_id, s, {conditions_text('s')} AS conditions FROM statements"
)
def count_conditions(v: Views) -> DataFrame:
    return _statements(v).withColumn("conditions", sqltext.count_conditions("s"))


def _has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def type_text(question: str) -> str:
    q = _TRIMMED.format(f"lower({question})")
    starts = " OR ".join(f"starts_with({q}, '{p}')" for p in sqltext.LOOKUP_PREFIXES)
    return f"""CASE WHEN {_has_any(q, sqltext.COMPARISON_WORDS)} THEN 'comparison'
  WHEN {_has_any(q, sqltext.TREND_WORDS)} THEN 'trend'
  WHEN {_has_any(q, sqltext.COUNT_WORDS)} THEN 'count'
  WHEN contains({q}, 'top ') THEN 'ranking' WHEN {starts} THEN 'lookup'
  WHEN {_has_any(q, sqltext.LIST_WORDS)} THEN 'list' ELSE 'other' END"""


def words_text(text: str) -> str:
    split = rf"regexp_split_to_array({_TRIMMED.format(text)}, '\s+')"
    return f"CAST(len(list_filter({split}, lambda w: w <> '')) AS int)"


def difficulty_text(question: str, sql: str) -> str:
    q = _TRIMMED.format(f"lower({question})")
    groups = (sqltext.VAGUE_WORDS, sqltext.COMPARISON_WORDS, sqltext.TREND_WORDS)
    wording = " + ".join(f"CASE WHEN {_has_any(q, g)} THEN 2 ELSE 0 END" for g in groups)
    words, conditions = words_text(q), conditions_text(sql)
    score = f"""({wording} + CASE WHEN {words} >= 12 THEN 2 WHEN {words} >= 8 THEN 1 ELSE 0 END
  + {features_text(sql)}
  + CASE WHEN {conditions} >= 3 THEN 2 WHEN {conditions} = 2 THEN 1 ELSE 0 END)"""
    return f"CASE WHEN {score} <= 3 THEN 'easy' WHEN {score} <= 7 THEN 'medium' ELSE 'hard' END"


# Questions: the corpus's, and whole conversation turns.
_QUESTIONS_SQL = """SELECT example_id, question AS q FROM sql_pairs
UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations"""


def _questions(v: Views) -> DataFrame:
    asked = v["sql_pairs"].select("example_id", F.col("question").alias("q"))
    turns = v.base("conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("example_id"),
        F.col("text").alias("q"),
    )
    return asked.unionByName(turns)


@query(
    with_views("sql_pairs", questions=_QUESTIONS_SQL)
    + f"SELECT example_id, {type_text('q')} AS query_type FROM questions"
)
def question_type(v: Views) -> DataFrame:
    return _questions(v).select("example_id", sqltext.question_type("q").alias("query_type"))


@query(
    with_views("sql_pairs", questions=_QUESTIONS_SQL)
    + f"SELECT example_id, {words_text('q')} AS word_count FROM questions"
)
def word_count(v: Views) -> DataFrame:
    return _questions(v).select("example_id", sqltext.word_count("q").alias("word_count"))


@query(
    with_views("sql_pairs")
    + f"""SELECT example_id, {difficulty_text("question", "gold_sql")} AS gold_level,
  {difficulty_text("question", "reply")} AS reply_level FROM sql_pairs"""
)
def difficulty(v: Views) -> DataFrame:
    return v["sql_pairs"].select(
        "example_id",
        sqltext.difficulty("question", "gold_sql").alias("gold_level"),
        sqltext.difficulty("question", "reply").alias("reply_level"),
    )


@query(
    with_views(
        "sql_pairs",
        labelled=f"""SELECT {type_text("question")} AS query_type,
  {difficulty_text("question", "gold_sql")} AS difficulty FROM sql_pairs""",
    )
    + """SELECT kind, label, CAST(count(*) AS bigint) AS n FROM (
  SELECT 'difficulty' AS kind, difficulty AS label FROM labelled
  UNION ALL SELECT 'query_type', query_type FROM labelled) x GROUP BY kind, label"""
)
def label_corpus(v: Views) -> DataFrame:
    return label_counts(label(v["sql_pairs"], "question", "gold_sql"))


def error_text(message: str, sql: str) -> str:
    e, s = f"lower({message})", f"lower({sql})"

    def has(*words: str) -> str:
        return "(" + " AND ".join(f"contains({e}, '{w}')" for w in words) + ")"

    joined = f"contains({s}, 'join')"
    return f"""CASE WHEN {message} IS NULL OR {message} = '' THEN 'unknown'
  WHEN {has("syntax error at or near")} OR {has("unterminated")} OR {has("invalid input syntax")}
    THEN 'syntax_error'
  WHEN {has("relation", "does not exist")} THEN 'missing_table'
  WHEN {has("column", "does not exist")} THEN 'missing_column'
  WHEN {has("ambiguous", "column")} THEN 'ambiguous_column'
  WHEN {has("must appear in the group by clause")} OR {has("aggregate", "group by")}
    THEN 'group_by_error'
  WHEN {has("from-clause", "missing")} OR {has("from-clause", "invalid reference")}
    OR ({joined} AND {has("from-clause")}) OR ({joined} AND {has("invalid reference")})
    THEN 'join_error'
  WHEN {has("operator does not exist")} OR {has("cannot cast")} THEN 'type_mismatch'
  WHEN {has("function", "does not exist")} THEN 'function_error'
  WHEN {has("permission denied")} THEN 'permission_error'
  WHEN {has("canceling statement due to")} OR {has("timeout")} THEN 'timeout_or_cancelled'
  ELSE 'other_execution_error' END"""


@query(
    with_views("sql_pairs")
    + f"SELECT example_id, {error_text('err', 'reply')} AS error_class FROM sql_pairs"
)
def classify_sql_error(v: Views) -> DataFrame:
    label_ = sqltext.classify_sql_error("err", "reply")
    return v["sql_pairs"].select("example_id", label_.alias("error_class"))


# A log of error conditions: one per event, by kind of event and period.
_CONDITIONS = {
    "click": "PARSE_SYNTAX_ERROR",
    "view": "TABLE_OR_VIEW_NOT_FOUND",
    "purchase": "UNRESOLVED_COLUMN.WITH_SUGGESTION",
    "error": "MISSING_AGGREGATION",
}


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'syntax_error'
  WHEN 'view' THEN 'missing_table'
  WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'join_error' ELSE 'missing_column' END
  WHEN 'error' THEN 'group_by_error' ELSE 'type_mismatch' END AS error_class FROM events"""
)
def classify_spark_error(v: Views) -> DataFrame:
    condition = F.lit("DATATYPE_MISMATCH.BINARY_OP_DIFF_TYPES")
    for kind, name in _CONDITIONS.items():
        condition = F.when(F.col("event_type") == kind, name).otherwise(condition)
    label_ = sqltext.classify_condition(condition, F.coalesce(F.col("value") > 50, F.lit(False)))
    return v.base("events").select("event_id", label_.alias("error_class"))
