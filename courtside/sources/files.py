"""CSV and text files: table CSVs, the question corpus, reports."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.cleaning import (
    blank_to_null,
    na_to_null,
    real_overflows,
    truncated_int,
)
from courtside.operators.integrity import REASONS
from courtside.schemas import INT_COLUMNS, TableSpec
from courtside.session import DROP_SHUFFLES, configured, pin

ARRIVAL = "_arrival"


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text under lower-case names, plus the arrival order.

    Arrival is (file, block, row id): row ids grow within a block, blocks by offset.
    ``multiline`` allows line breaks inside quotes but makes files unsplittable.
    """
    raw = spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        quote='"',
        escape='"',
        multiLine=multiline,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    arrival = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(
        *[F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns],
        arrival.alias(ARRIVAL),
    )


def _clean_column(name: str, target: T.DataType) -> tuple[Column, Column, Column | None]:
    """A CSV text column's typed value, a quick doubt about it, and the reason it was not read.

    There is a doubt where a text gave no value. Texts that are plain numbers or dates need no
    test for missing-value spellings, as none of these is one.
    """
    present = blank_to_null(na_to_null(name))
    if isinstance(target, T.StringType):
        return present, F.lit(False), None
    if name in INT_COLUMNS:
        value = truncated_int(present).cast(target)
    else:
        value = present.try_cast(target)
    whole = name in INT_COLUMNS and isinstance(target, T.FloatType)
    plain = F.col(name).try_cast("int").cast(target) if whole else F.col(name).try_cast(target)
    if isinstance(target, T.FloatType):
        value = F.when(~real_overflows(present), value)
        plain = F.when(F.abs(plain) < float("inf"), plain)
    quick = F.coalesce(plain, value)
    unreadable = present.isNotNull() & value.isNull()
    doubt = F.col(name).isNotNull() & quick.isNull()
    return quick, doubt, F.when(unreadable, f"{name}: not a valid {target.simpleString()}")


def clean_row(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed table rows from CSV text, with the reasons a value could not be read.

    Missing-value spellings and blanks become NULL; the declared integer columns are
    truncated. A column the table does not have makes every row bad. A bad number
    sets its row aside; it does not end the load. Row ids are kept where the file has them.

    Reasons are looked for only in rows with a doubt: Spark interprets them, column by column.
    """
    known = set(spec.columns)
    values, doubts, reasons = [], [], []
    for column in spec.columns if spec.serial in df.columns else spec.loaded_columns:
        target = spec.schema[column].dataType
        if column not in df.columns:
            values.append(F.lit(None).cast(target).alias(column))
            continue
        value, doubt, reason = _clean_column(column, target)
        values.append(value.alias(column))
        if reason is not None:
            doubts.append(doubt)
            reasons.append(reason)
    unknown = [c for c in df.columns if c not in known and c != ARRIVAL]
    if unknown:
        doubts.append(F.lit(True))
        reasons += [F.lit(f"unknown column: {c}") for c in unknown]
    nothing = F.array().cast("array<string>")
    found = F.array_compact(F.array(*reasons)).cast("array<string>") if reasons else nothing
    doubtful = reduce(or_, doubts, F.lit(False))
    carried = [ARRIVAL] if ARRIVAL in df.columns else []
    return df.select(*values, *carried, F.when(doubtful, found).otherwise(nothing).alias(REASONS))


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, as a quoted line break leaves it."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


# What stands for a quoted part of a record when its form is checked.
_QUOTED = "\u0001"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as ``(file, at, text)`` without their header, put together from lines.

    Quotes are doubled inside values, so a line stands inside a value if the quotes before
    it in its file are odd in number. Splits are counted first, and the counts of those
    before say how each begins: no task reads more than a split, but for the parts of one
    record. ``at`` is the block and the row id of a record's first line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2).alias("odd"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd")).select(
        "file", "block", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("file", "block").orderBy("row")
    above = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = lines.join(splits, ["file", "block"]).withColumn(
        "_at", F.when((F.col("_before") + above) % 2 == 0, F.struct("block", "row"))
    )
    placed = pin(begins.withColumn("at", F.last("_at", ignorenulls=True).over(inside)))
    # The lines before the first record of a split belong to the last one before it.
    first = F.struct("_at", F.col("value").endswith("\r").alias("returns"))
    lasts = placed.groupBy("file", "block").agg(
        F.max("at").alias("at"), F.min(F.when(F.col("_at").isNotNull(), first)).alias("first")
    )
    whole_file = Window.partitionBy("file")
    carried = lasts.select(
        "file",
        "block",
        F.last("at", ignorenulls=True).over(earlier).alias("_carried"),
        F.min("first").over(whole_file).alias("_header"),
    )
    known = placed.join(carried, ["file", "block"]).withColumn("at", F.coalesce("at", "_carried"))
    known = known.where(F.col("at") != F.col("_header._at")).withColumn(
        "returns", F.col("_header.returns")
    )
    alone = F.col("_at").isNotNull() & (F.col("odd") == 0)
    parts = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    joined = known.where(~alone).groupBy("file", "at", "returns").agg(
        F.array_join(F.transform(parts, lambda part: part["value"]), "\n").alias("text")
    )
    single = known.where(alone).select("file", "at", "returns", F.col("value").alias("text"))
    # Where lines end in both characters, breaks inside values come back as line feeds.
    broken = F.when(F.col("returns"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    records = single.unionByName(joined).withColumn("text", broken).drop("returns")
    return records.withColumn("text", F.regexp_replace("text", r"\r$", "")).where("text <> ''")


def scan_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``scan_csv`` reads with ``multiline``, by as many tasks as the files have splits.

    Files in one split, and files where a quote stands inside an unquoted value (so that
    quotes don't tell where records end), are read whole by one task each. Lines end in a
    line feed, with or without a carriage return.
    """
    whole = scan_csv(spark, path, multiline=True)
    if spark.read.text(path).rdd.getNumPartitions() <= 1:
        return whole
    records = _records(spark, path)
    shape = F.regexp_replace("text", '"[^"]*"', _QUOTED)
    odd = shape.rlike(f"[^,{_QUOTED}]{_QUOTED}|{_QUOTED}[^,{_QUOTED}]|\"")
    if not records.where(odd).limit(1).isEmpty():
        return whole
    names = [c for c in whole.columns if c != ARRIVAL]
    options = {
        "quote": '"',
        "escape": '"',
        "multiLine": "true",
        "lineSep": "\n",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.withColumn("_value", F.from_csv("text", schema, options))
    arrival = F.struct("file", F.col("at.block").alias("block"), F.col("at.row").alias("row"))
    return parsed.select(
        *[F.col(f"_value.c{i}").alias(name) for i, name in enumerate(names)], arrival.alias(ARRIVAL)
    )


def read_table_csv(
    spark: SparkSession, path: str, spec: TableSpec, multiline: bool | None = None
) -> DataFrame:
    """A table's CSV as typed rows with ``_arrival`` and ``_reasons``.

    Values may hold quoted line breaks. By default the file is scanned for them first: one
    without any is read line by line, which splits large files and gives the same rows;
    others are put together from lines (see ``scan_quoted_csv``).
    """
    if multiline is None:
        multiline = has_quoted_breaks(spark, path)
    scanned = scan_quoted_csv(spark, path) if multiline else scan_csv(spark, path)
    return clean_row(scanned, spec)


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The question/SQL corpus in file order; quoted fields may hold line breaks.

    ``limit`` keeps the first rows of the file, as an evaluation run may ask for.
    """
    scanned = scan_quoted_csv(spark, path)
    corpus = scanned if limit is None else scanned.orderBy(ARRIVAL).limit(limit)
    return corpus


def write_csv(
    df: DataFrame, path: str, columns: list[str] | None = None, compression: str | None = None
) -> None:
    """CSV with a header and a fixed column order; quotes are doubled, outer blanks stay."""
    out = df.select(*columns) if columns else df
    with configured(df.sparkSession, DROP_SHUFFLES):
        out.write.csv(
            path,
            header=True,
            mode="overwrite",
            compression=compression,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )


def write_summary(lines: DataFrame, folder: str, at: datetime | None = None) -> str:
    """A report of a few dozen ordered ``(line_no, line)`` rows as one text file."""
    stamp = (at or datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")
    path = f"{folder}/eval_summary_{stamp}"
    lines.orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(path)
    return path


def replace_all(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Drop what is stored and write the table anew."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
