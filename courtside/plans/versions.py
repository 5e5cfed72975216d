"""Which folders make up a stored warehouse: numbered versions, of which the last one counts.

Data folders are written once and never changed. A version is one small file that names the
folders it consists of, the batches applied so far and the highest row id given out in each
table. It is written last, so a job that ends before that leaves the version before it in
force, and folders that nobody reads.

Tables found under ``root`` itself (written by other means) are part of every version.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.keys import allocate_ids
from courtside.schemas import TABLES, TableSpec

SEASON = "season_id"
_LINES = "kind string, table string, season int, name string, value bigint"


@dataclass(frozen=True)
class Part:
    """One folder of a table. With a season it is all there is of that season."""

    table: str
    season: int | None
    name: str


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    batches: frozenset[str] = frozenset()
    highest_ids: dict[str, int] = field(default_factory=dict)

    def lines(self) -> list[tuple]:
        parts = [("part", p.table, p.season, p.name, None) for p in self.parts]
        batches = [("batch", None, None, b, None) for b in sorted(self.batches)]
        ids = [("highest_id", t, None, None, n) for t, n in sorted(self.highest_ids.items())]
        return [("version", None, None, None, self.number), *parts, *batches, *ids]


def _missing(error: AnalysisException) -> bool:
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error
    return True


def last_version(spark: SparkSession, root: str) -> Version:
    """The version in force; version 0 is an empty one."""
    path = f"{root}/versions/manifest"
    try:
        files = spark.read.schema(_LINES).json(path).inputFiles()
    except AnalysisException as error:
        if _missing(error):
            return Version()
    numbers = [int(re.search(r"version=(\d+)", f).group(1)) for f in files]
    if not numbers:
        return Version()
    number = max(numbers)
    if numbers.count(number) > 1:
        raise RuntimeError(f"two jobs wrote version {number} of {root} at the same time")
    rows = spark.read.schema(_LINES).json(f"{path}/version={number}").collect()
    return Version(
        number,
        tuple(Part(r["table"], r["season"], r["name"]) for r in rows if r["kind"] == "part"),
        frozenset(r["name"] for r in rows if r["kind"] == "batch"),
        {r["table"]: r["value"] for r in rows if r["kind"] == "highest_id"},
    )


def _read_parts(
    spark: SparkSession, root: str, spec: TableSpec, parts: list[Part]
) -> DataFrame:
    base = f"{root}/versions/{spec.name}"
    folders = [f"{base}/part={p.name}" for p in parts]
    read = spark.read.schema(spec.schema).option("basePath", base).parquet(*folders)
    return read.select(*spec.columns)


def read_table(spark: SparkSession, root: str, spec: TableSpec, version: Version) -> DataFrame:
    """A table of a version; one that nobody wrote is empty."""
    parts = [p for p in version.parts if p.table == spec.name]
    replaced = [p for p in parts if p.season is not None]
    shared = [p for p in parts if p.season is None]
    frames = []
    try:
        frames.append(spark.read.schema(spec.schema).parquet(f"{root}/{spec.name}"))
    except AnalysisException as error:
        _missing(error)
    if shared:
        frames.append(_read_parts(spark, root, spec, shared))
    if replaced:
        seasons = [p.season for p in replaced]
        kept = F.col(SEASON).isNull() | ~F.col(SEASON).isin(seasons)
        frames = [f.where(kept) for f in frames]
        frames.append(_read_parts(spark, root, spec, replaced))
    if not frames:
        return spark.createDataFrame([], spec.schema)
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


class Draft:
    """The next version while its folders are written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.base = last_version(spark, root)
        self.parts = list(self.base.parts)
        self.highest_ids = dict(self.base.highest_ids)

    def read(self) -> dict[str, DataFrame]:
        return {
            name: read_table(self.spark, self.root, spec, self.base)
            for name, spec in TABLES.items()
        }

    def write(self, rows: DataFrame, table: str, season: int | None = None) -> None:
        """Add rows to a table, or with a season put them in place of that season's."""
        spec = TABLES[table]
        part = Part(table, season, f"p{uuid.uuid4().hex}")
        partitions = [SEASON] if SEASON in spec.columns else []
        # Rebalancing sizes the files: neither one per task and season nor one per season.
        writer = rows.select(*spec.columns).hint("rebalance", *partitions).write
        path = f"{self.root}/versions/{table}/part={part.name}"
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        if season is not None:
            self.parts = [p for p in self.parts if (p.table, p.season) != (table, season)]
        self.parts.append(part)

    def with_ids(self, rows: DataFrame, table: str, stored: DataFrame) -> DataFrame:
        """Give the rows of a pinned frame that have no id the next ones of their table.

        The highest id ever given is part of the version, so ids of replaced rows don't
        come back; of a table without one it is the highest id stored.
        """
        spec = TABLES[table]
        highest = self.highest_ids.get(table)
        if highest is None:
            highest = stored.agg(F.max(spec.serial)).first()[0] or 0
        if spec.serial in rows.columns:
            known = rows.where(F.col(spec.serial).isNotNull())
            new = rows.where(F.col(spec.serial).isNull()).drop(spec.serial)
        else:
            known, new = None, rows
        keys = list(spec.unique) or spec.loaded_columns
        numbered = allocate_ids(new, keys, highest, spec.serial)
        self.highest_ids[table] = highest + new.count()
        return numbered if known is None else known.unionByName(numbered)

    def commit(self, batch: str | None = None) -> Version:
        """Put the new version in force."""
        named = self.base.batches | ({batch} if batch is not None else frozenset())
        version = replace(
            self.base,
            number=self.base.number + 1,
            parts=tuple(self.parts),
            batches=named,
            highest_ids=self.highest_ids,
        )
        lines = self.spark.createDataFrame(version.lines(), _LINES).coalesce(1)
        # A job commits its one file by a rename. Appending never clears another's file.
        path = f"{self.root}/versions/manifest/version={version.number}"
        lines.write.mode("append").json(path)
        return last_version(self.spark, self.root)
