"""SQL-text and question features. Every function maps Column to Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.cleaning import SPACE, _col, strip

# ---------------------------------------------------------------------------
# Patterns and word lists.
TOKEN = r"(?U)[a-z_][a-z0-9_]*|\d+|!=|<=|>=|==|[(),;=*<>+-/]"
NO_SQL = "SELECT NULL -- model produced no valid SQL"

COMPARISON_WORDS = ["compare", "vs", "or", "between"]
TREND_WORDS = ["over time", "changed", "improved", "increase", "decrease", "years"]
COUNT_WORDS = ["how many", "count", "number of"]
LIST_WORDS = ["all players", "list all", "show me all"]
LOOKUP_PREFIXES = ["who ", "which player", "which team"]
VAGUE_WORDS = [
    "best", "better", "greatest", "hardest", "impactful", "efficient", "goat",
    "ballin", "balled", "cooked", "eating", "wet", "sickest", "absolute", "elite",
    "deserved", "most valuable",
]
# ---------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _has_any(text: Column, words: Iterable[str]) -> Column:
    return _any(text.contains(w) for w in words)


def _occurrences(text: Column, word: str) -> Column:
    removed = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (removed / len(word)).cast("int")


def clean_sql(reply: Column | str) -> Column:
    """The first SELECT statement in a model's reply, without fences or comments."""
    text = F.regexp_replace(_col(reply), "(?iu)```sql", "")
    text = strip(F.replace(text, F.lit("```"), F.lit("")))
    text = F.regexp_replace(text, rf"(?iU)^(A:|Answer:|SQL:|Query:){SPACE}*", "")
    text = F.regexp_replace(text, r"--[^\n]*", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    text = strip(F.regexp_replace(text, rf"(?U){SPACE}+", " "))
    # Up to the first semicolon, then from the first SELECT if it starts elsewhere.
    first = F.regexp_extract(text, r"(?s)^[^;]*;?", 0)
    select = strip(F.regexp_extract(first, r"(?isU)SELECT\b.*", 0))
    return F.when(text.isNull(), None).when(select == "", NO_SQL).otherwise(select)


def sql_tokens(sql: Column | str) -> Column:
    """Lower-case tokens: words, digit runs, operators and punctuation."""
    return F.regexp_extract_all(F.lower(strip(sql)), F.lit(TOKEN), F.lit(0))


# One character per distinct token: a small vocabulary by its position, a larger one
# from U+0100 on and over the surrogate gap.
_FIRST_CODE = 256
_SURROGATES = 0xD800
_MAX_VOCABULARY = 0x110000 - _FIRST_CODE - 2048


def _small_code(position: Column) -> Column:
    return F.char(position)


def _wide_code(position: Column) -> Column:
    code = position + (_FIRST_CODE - 1)
    code = F.when(code >= _SURROGATES, code + 2048).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _as_characters(
    tokens: Column, shared: Column, other: int, code: Callable[[Column], Column]
) -> Column:
    """``tokens`` as characters: shared ones by their place, all others as ``other``."""

    def coded(token: Column) -> Column:
        place = F.array_position(shared, token)
        return code(F.when(place > 0, place + 2).otherwise(F.lit(other).cast("bigint")))

    return F.array_join(F.transform(tokens, coded), "")


def _row_by_row(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays by the table's rows: slow, for any vocabulary."""
    places = F.sequence(F.lit(1), F.size(b))

    def next_row(row: Column, token: Column) -> Column:
        def extend(made: Column, j: Column) -> Column:
            differ = F.when(F.get(b, j - 1) == token, 0).otherwise(1)
            least = F.least(
                F.get(row, j) + 1, F.get(row, j - 1) + differ, F.element_at(made, -1) + 1
            )
            return F.concat(made, F.array(least))

        return F.aggregate(places, F.array(F.get(row, F.lit(0)) + 1), extend)

    table = F.aggregate(a, F.sequence(F.lit(0), F.size(b)), next_row)
    return (
        F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(table, -1)).cast("int")
    )


def _without_common_start(a: Column, b: Column) -> tuple[Column, Column]:
    """Both arrays behind the elements they begin with alike; the arrays must differ."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.slice(a, first, F.size(a)), F.slice(b, first, F.size(b))


def token_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance between two token arrays.

    What both begin and end with is cut off. Each token left is written as one character:
    tokens both sides have by their place among these, all tokens only one side has as
    one character of that side, since they match nothing. The built-in string distance
    then does the work in the JVM. A pair that shares more distinct tokens than Unicode
    has characters is measured row by row instead.
    """

    def measured(q: Column) -> Column:
        def coded(code: Callable[[Column], Column]) -> Column:
            return F.levenshtein(
                _as_characters(q.a, q.v, 1, code), _as_characters(q.b, q.v, 2, code)
            )

        return (
            F.when(F.size(q.v) + 3 < _FIRST_CODE, coded(_small_code))
            .when(F.size(q.v) + 3 <= _MAX_VOCABULARY, coded(_wide_code))
            .otherwise(_row_by_row(q.a, q.b))
        )

    def pair(left: Column, right: Column) -> Column:
        return F.struct(left.alias("a"), right.alias("b"))

    def cut_end(p: Column) -> Column:
        left, right = _without_common_start(F.reverse(p.a), F.reverse(p.b))
        ends = F.when((F.size(p.a) == 0) | (F.size(p.b) == 0), p).otherwise(pair(left, right))
        return let(
            ends,
            lambda e: let(
                F.struct(
                    e.a.alias("a"), e.b.alias("b"), F.array_intersect(e.a, e.b).alias("v")
                ),
                measured,
            ),
        )

    def distance(p: Column) -> Column:
        start = pair(*_without_common_start(p.a, p.b))
        return F.when(p.a == p.b, F.lit(0)).otherwise(let(start, cut_end))

    return let(pair(_col(a), _col(b)), distance)


def token_similarity(a: Column | str, b: Column | str, distance: Column | None = None) -> Column:
    """``1 - distance / longer length``; two empty sides give 1."""
    dist = token_distance(a, b) if distance is None else distance
    longer = F.greatest(F.size(_col(a)), F.size(_col(b)), F.lit(1))
    return 1.0 - dist / longer


def char_distance(a: Column | str, b: Column | str) -> Column:
    """Character Levenshtein distance of the raw texts."""
    return F.levenshtein(_col(a), _col(b))


def sql_feature_count(sql: Column | str) -> Column:
    """Complexity points for clauses; keywords count only between blanks."""
    s = F.lower(_col(sql))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    return (
        _occurrences(s, " join ")
        + points(s.contains(" group by "), 2)
        + points(s.contains(" having "), 2)
        + points(s.contains(" order by "), 1)
        + points(s.contains(" limit "), 1)
        + points(s.contains(" where "), 1)
        + points(_has_any(s, [" in (", "select max", "select min"]), 2)
        + points(_has_any(s, [" avg(", " sum(", " count(", " max(", " min("]), 1)
    ).cast("int")


def count_conditions(sql: Column | str) -> Column:
    """Conditions in the first WHERE clause: its ANDs and ORs plus one."""
    s = F.lower(_col(sql))
    clause = F.substring(s, F.locate(" where ", s) + 7, F.length(s))
    for end in (" group by ", " order by ", " limit "):
        clause = F.substring_index(clause, end, 1)
    found = _occurrences(clause, " and ") + _occurrences(clause, " or ") + 1
    return F.when(s.contains(" where "), found).otherwise(0).cast("int")


def question_text(question: Column | str) -> Column:
    """The question as the rules look at it: lower-case, stripped, never missing."""
    return strip(F.lower(F.coalesce(_col(question), F.lit("nan"))))


def question_type(question: Column | str, prepared: bool = False) -> Column:
    """Rough kind of question; the first matching rule wins.

    With ``prepared`` the argument is already a ``question_text``.
    """
    q = _col(question) if prepared else question_text(question)
    return (
        F.when(_has_any(q, COMPARISON_WORDS), "comparison")
        .when(_has_any(q, TREND_WORDS), "trend")
        .when(_has_any(q, COUNT_WORDS), "count")
        .when(q.contains("top "), "ranking")
        .when(_any(q.startswith(p) for p in LOOKUP_PREFIXES), "lookup")
        .when(_has_any(q, LIST_WORDS), "list")
        .otherwise("other")
    )


def word_count(text: Column | str) -> Column:
    """Whitespace-separated words; a missing text counts as one word."""
    words = F.split(strip(F.coalesce(_col(text), F.lit("nan"))), rf"(?U){SPACE}+")
    return F.size(F.filter(words, lambda w: w != "")).cast("int")


def difficulty_score(
    question: Column | str, sql: Column | str, prepared: bool = False
) -> Column:
    q = _col(question) if prepared else question_text(question)
    s = F.coalesce(_col(sql), F.lit("nan"))
    words = word_count(q)
    conditions = count_conditions(s)
    wording = [
        F.when(_has_any(q, group), 2).otherwise(0)
        for group in (VAGUE_WORDS, COMPARISON_WORDS, TREND_WORDS)
    ]
    length = F.when(words >= 12, 2).when(words >= 8, 1).otherwise(0)
    filters = F.when(conditions >= 3, 2).when(conditions == 2, 1).otherwise(0)
    return sum(wording, length + filters + sql_feature_count(s)).cast("int")


def difficulty_label(score: Column | str) -> Column:
    """``easy``, ``medium`` or ``hard``."""
    score = _col(score)
    return F.when(score <= 3, "easy").when(score <= 7, "medium").otherwise("hard")


def difficulty(question: Column | str, sql: Column | str) -> Column:
    """The difficulty label of a question and its SQL."""
    return difficulty_label(difficulty_score(question, sql))


def classify_sql_error(message: Column | str, sql: Column | str | None = None) -> Column:
    """Class of a PostgreSQL error message; the first matching rule wins."""
    raw = _col(message)
    e = F.lower(raw)
    s = F.lower(F.coalesce(_col(sql) if sql is not None else F.lit(""), F.lit("")))
    absent = e.contains("does not exist")
    from_clause = e.contains("from-clause")
    bad_reference = e.contains("invalid reference")
    rules = [
        (
            "syntax_error",
            _has_any(e, ["syntax error at or near", "unterminated", "invalid input syntax"]),
        ),
        ("missing_table", e.contains("relation") & absent),
        ("missing_column", e.contains("column") & absent),
        ("ambiguous_column", e.contains("ambiguous") & e.contains("column")),
        (
            "group_by_error",
            e.contains("must appear in the group by clause")
            | (e.contains("aggregate") & e.contains("group by")),
        ),
        (
            "join_error",
            (from_clause & (e.contains("missing") | bad_reference))
            | (s.contains("join") & (from_clause | bad_reference)),
        ),
        ("type_mismatch", _has_any(e, ["operator does not exist", "cannot cast"])),
        ("function_error", e.contains("function") & absent),
        ("permission_error", e.contains("permission denied")),
        ("timeout_or_cancelled", _has_any(e, ["canceling statement due to", "timeout"])),
    ]
    label = F.when(raw.isNull() | (raw == ""), "unknown")
    for name, condition in rules:
        label = label.when(condition, name)
    return label.otherwise("other_execution_error")


# Spark error conditions and the class each belongs to.
CONDITION_CLASSES = {
    "PARSE_SYNTAX_ERROR": "syntax_error",
    "PARSE_EMPTY_STATEMENT": "syntax_error",
    "UNCLOSED_BRACKETED_COMMENT": "syntax_error",
    "TABLE_OR_VIEW_NOT_FOUND": "missing_table",
    "UNRESOLVED_COLUMN": "missing_column",
    "AMBIGUOUS_REFERENCE": "ambiguous_column",
    "MISSING_GROUP_BY": "group_by_error",
    "MISSING_AGGREGATION": "group_by_error",
    "GROUP_BY_AGGREGATE": "group_by_error",
    "DATATYPE_MISMATCH": "type_mismatch",
    "CAST_INVALID_INPUT": "type_mismatch",
    "UNRESOLVED_ROUTINE": "function_error",
    "WRONG_NUM_ARGS": "function_error",
    "INSUFFICIENT_TABLE_PRIVILEGE": "permission_error",
    "OPERATION_CANCELED": "timeout_or_cancelled",
    "JOB_CANCELLED": "timeout_or_cancelled",
    "SPARK_JOB_CANCELLED": "timeout_or_cancelled",
    "STATEMENT_TIMEOUT": "timeout_or_cancelled",
}


def classify_condition(
    condition: Column | str, unknown_qualifier: Column | None = None
) -> Column:
    """Class of a Spark error condition name.

    Sub-conditions follow their parent. ``unknown_qualifier`` marks an unresolved
    column whose table alias is not in the statement: PostgreSQL reports that as a
    missing FROM-clause entry.
    """
    name = _col(condition)
    parent = F.substring_index(name, ".", 1)
    label = F.when(name.isNull() | (name == ""), "unknown")
    if unknown_qualifier is not None:
        label = label.when((parent == "UNRESOLVED_COLUMN") & unknown_qualifier, "join_error")
    by_class: dict[str, list[str]] = {}
    for spark_name, error_class in CONDITION_CLASSES.items():
        by_class.setdefault(error_class, []).append(spark_name)
    for error_class, names in by_class.items():
        label = label.when(parent.isin(names), error_class)
    return label.otherwise("other_execution_error")
