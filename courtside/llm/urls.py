"""URL filters: captures judged by the list entries that were active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and a dot at the end; null if none."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, r"^[^@]*@", ""), r"\.?(:\d*)?$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment; ``/`` if empty."""
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#\s]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def patterns_of(url: Column) -> Column:
    """The patterns a URL may match, as ``pattern`` and ``rank`` (higher is more specific).

    Its host and every parent domain (``example.com``), then the host with every leading
    part of the path that ends at a slash, and the whole path (``example.com/a/``).
    """
    labels = F.split(host_of(url), r"\.")
    count = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), count),
        lambda n: F.struct(
            F.array_join(F.slice(labels, count - n + 1, n), ".").alias("pattern"), n.alias("rank")
        ),
    )
    # "/a/b" is cut into "", "a", "b": the prefixes are "/", "/a/" and the path itself.
    parts = F.split(path_of(url), "/")
    steps = F.size(parts)
    prefixes = F.transform(
        F.sequence(F.lit(1), steps),
        lambda n: F.struct(
            F.concat(
                host_of(url),
                F.array_join(F.slice(parts, F.lit(1), n), "/"),
                F.when((n < steps), "/").otherwise(""),
            ).alias("pattern"),
            (n + count).alias("rank"),
        ),
    )
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (``pattern``, ``listed_at``, ``action``) as intervals, one open at the end.

    An entry holds until the next one of its pattern; of several at one time the action
    that is last in the alphabet counts. ``allow`` and ``remove`` entries end a ``block``.
    Entries with a null are left out; repeated entries count once.
    """
    once = (
        entries.where("pattern IS NOT NULL AND listed_at IS NOT NULL AND action IS NOT NULL")
        .groupBy(F.lower("pattern").alias("pattern"), "listed_at")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return once.select("pattern", "action", F.col("listed_at").alias("since"), following.alias("until"))


def time_bucket(time: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(time.cast("timestamp")) / (days * 86_400))


def in_buckets(intervals: DataFrame, times: DataFrame, days: int) -> DataFrame:
    """Intervals laid into the time buckets they touch, of those that hold a time in ``_at``.

    The driver sees which buckets those are: a number for each span of ``days`` days in
    which anything was captured, so no more than the spans of the captured time. Spans
    without a capture cost nothing, however far apart the captures are.
    """
    held = times.where(F.col("_at").isNotNull()).select(time_bucket(F.col("_at"), days).alias("b"))
    found = sorted(row["b"] for row in held.distinct().collect())
    # One literal, however many they are.
    occupied = F.from_json(F.lit(str(found)), "array<bigint>")
    since, until = time_bucket(F.col("since"), days), time_bucket(F.col("until"), days)
    touched = F.filter(occupied, lambda b: (b >= since) & (until.isNull() | (b <= until)))
    return intervals.withColumn("_bucket", F.explode(touched))


def judge_captures(
    captures: DataFrame,
    entries: DataFrame,
    bucket_days: int = 30,
    id_column: str = "page_id",
    url_column: str = "url",
    time_column: str = "fetched_at",
) -> DataFrame:
    """Every capture with the entry that decides it at the time it was fetched.

    Columns: ``id_column``, ``pattern`` and ``action`` of the deciding entry, ``since`` when it
    was active, and ``blocked``. Of the entries active at the capture's time (from their
    date on, up to the next entry of the pattern) the most specific pattern decides, see
    :func:`patterns_of`; with none the capture isn't blocked and the three are null. An
    active ``remove`` entry says nothing, so less specific patterns decide.

    Null or unreadable URLs and null times match nothing. Repeated captures give a row
    each, an empty list blocks nothing, an empty table gives no rows; other columns are
    left out.

    As-of join by time buckets: intervals are laid into the buckets of ``bucket_days`` they
    touch, captures into the one of their time, and both meet on pattern and bucket, so a
    pattern with a long history isn't compared entry by entry. Captures of a common host
    are dealt over several tasks. Intervals are laid only into buckets that hold captures.
    """
    place = [F.col(id_column), F.col(url_column), F.col(time_column).cast("timestamp")]
    key = F.concat(F.hex(F.xxhash64(*place)), F.hex(F.xxhash64(F.lit("second"), *place)))
    rows = captures.select(
        F.col(id_column),
        F.col(url_column).cast("string").alias("_url"),
        F.col(time_column).cast("timestamp").alias("_at"),
        key.alias("_key"),
    )
    # Equal captures are judged once and expanded at the end.
    candidates = rows.select(
        "_key", "_at", time_bucket(F.col("_at"), bucket_days).alias("_bucket"), F.explode(patterns_of(F.col("_url"))).alias("p")
    ).select("_key", "_at", "_bucket", F.lower("p.pattern").alias("pattern"), "p.rank")
    intervals = validity_intervals(entries).where(F.col("action") != "remove")
    laid = stored(in_buckets(intervals, rows, bucket_days), "url-intervals")
    active = salted_join(candidates, laid, ["pattern", "_bucket"], ["_key"]).where(
        (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    )
    decided = active.groupBy("_key").agg(
        F.max(F.struct("rank", "pattern", "action", "since")).alias("d")
    )
    return rows.join(decided, "_key", "left").select(
        id_column,
        F.col("d.pattern").alias("pattern"),
        F.col("d.action").alias("action"),
        F.col("d.since").alias("since"),
        F.coalesce(F.col("d.action") == "block", F.lit(False)).alias("blocked"),
    )
