"""Cleaning functions on dirty values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.catalogue import query
from courtside.fixtures import Views, with_views
from courtside.functions import cleaning as c
from courtside.operators.integrity import domain_violations
from courtside.schemas import TABLES
from courtside.sources.files import clean_row

_INT = r"CASE WHEN regexp_full_match(v, '\s*[+-]?\d+\s*') THEN try_cast(trim(v) AS int) END"


@query(
    with_views("dirty_values")
    + f"""SELECT id, {_INT} AS from_text, CAST(trunc(o_totalprice) AS int) AS from_number
FROM dirty_values JOIN orders ON id = o_orderkey"""
)
def safe_int(v: Views) -> DataFrame:
    prices = v.base("orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return (
        v["dirty_values"]
        .join(prices, "id")
        .select(
            "id",
            c.safe_int("v").alias("from_text"),
            c.safe_int("o_totalprice").alias("from_number"),
        )
    )


@query(
    with_views("dirty_values")
    + """SELECT id, CASE WHEN NOT isnan(f) THEN round(CAST(f AS double), 4) END AS value,
  CAST(coalesce(isnan(f), false) AS int) AS is_nan
FROM (SELECT id, try_cast(v AS float) AS f FROM dirty_values) x"""
)
def safe_float(v: Views) -> DataFrame:
    parsed = v["dirty_values"].select("id", c.safe_float("v").alias("f"))
    return parsed.select(
        "id",
        F.round(F.when(~F.isnan("f"), F.col("f")).cast("double"), 4).alias("value"),
        F.coalesce(F.isnan("f").cast("int"), F.lit(0)).alias("is_nan"),
    )


@query(
    with_views("dirty_values")
    + r"""SELECT id, height, CASE WHEN regexp_matches(height, '^\d+-\d+')
  THEN CAST(try_cast(string_split(height, '-')[1] AS int) * 12
    + try_cast(string_split(height, '-')[2] AS int) AS int) END AS inches FROM dirty_values"""
)
def height_to_inches(v: Views) -> DataFrame:
    return v["dirty_values"].select("id", "height", c.height_to_inches("height").alias("inches"))


@query(
    with_views("dirty_values")
    + r"""SELECT id, season, CAST(CASE WHEN regexp_matches(season, '^\d+(-|$)')
  THEN 20000 + CAST(string_split(season, '-')[1] AS int) ELSE 0 END AS int) AS season_id
FROM dirty_values"""
)
def season_to_int(v: Views) -> DataFrame:
    return v["dirty_values"].select("id", "season", c.season_to_int("season").alias("season_id"))


@query(
    """SELECT o_orderkey AS id, CAST(20000 + year(o_orderdate) - 1 AS int) AS season_id
FROM orders"""
)
def end_year_season(v: Views) -> DataFrame:
    season = c.season_from_end_year(F.year("o_orderdate"))
    return v.base("orders").select(F.col("o_orderkey").alias("id"), season.alias("season_id"))


@query(
    with_views("dirty_values")
    + r"""SELECT id, CASE WHEN NOT regexp_full_match(v, '\s*') THEN v END AS value
FROM dirty_values"""
)
def blank_to_null(v: Views) -> DataFrame:
    return v["dirty_values"].select("id", c.blank_to_null("v").alias("value"))


# The dirty text as a CSV row: once where the column is an integer, once as a name.
@query(
    with_views(
        "dirty_values",
        present=r"""SELECT id, CASE WHEN NOT regexp_full_match(v, '\s*')
    AND v NOT IN ('NA', 'NaN') THEN v END AS v FROM dirty_values""",
    )
    + """SELECT id, CAST(trunc(try_cast(v AS double)) AS int) AS player_id, v AS player_name,
  CASE WHEN v IS NOT NULL AND try_cast(v AS double) IS NULL
    THEN 'player_id: not a valid int' ELSE '' END AS reasons FROM present"""
)
def clean_value(v: Views) -> DataFrame:
    rows = v["dirty_values"].select(
        F.col("v").alias("player_id"),
        F.col("v").alias("player_name"),
        F.col("id").alias("_arrival"),
    )
    cleaned = clean_row(rows, TABLES["player"])
    return cleaned.select(
        F.col("_arrival").alias("id"),
        "player_id",
        "player_name",
        F.array_join("_reasons", "; ").alias("reasons"),
    )


@query(
    with_views("dirty_values")
    + """SELECT id, nullif(v, '') AS plain, coalesce(nullif(v, ''),
  CASE WHEN v IS NULL THEN 'None' END) AS quirk FROM dirty_values"""
)
def stringify_or_null(v: Views) -> DataFrame:
    return v["dirty_values"].select(
        "id",
        c.stringify("v").alias("plain"),
        c.stringify("v", py_quirk=True).alias("quirk"),
    )


@query(
    with_views("dirty_values")
    + """SELECT id, CASE WHEN v NOT IN ('', 'NA', 'NaN') THEN v END AS value FROM dirty_values"""
)
def na_tokens(v: Views) -> DataFrame:
    return v["dirty_values"].select("id", c.na_to_null("v").alias("value"))


@query(
    with_views("player")
    + """SELECT player_id, concat_ws('; ',
    CASE WHEN draft_number IN ('49', '50') THEN 'country: too long' END,
    CASE WHEN length(concat(college, country)) > 15 THEN 'draft_year: too long' END) AS reasons
FROM player WHERE draft_number IN ('49', '50') OR length(concat(college, country)) > 15"""
)
def domain_check(v: Views) -> DataFrame:
    long_text = F.repeat(F.lit("x"), 300)
    spoiled = v["player"].withColumns(
        {
            "country": F.when(F.col("draft_number").isin("49", "50"), long_text).otherwise(
                F.col("country")
            ),
            "draft_year": F.when(
                F.char_length(F.concat("college", "country")) > 15, long_text
            ).otherwise(F.col("draft_year")),
        }
    )
    found = domain_violations(spoiled, TABLES["player"])
    return found.select("player_id", F.array_join("_reasons", "; ").alias("reasons"))
