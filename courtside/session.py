"""Where jobs may write: the shared folder the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most rows and bytes a checked side may have and still be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Most rows of a side that holds nothing but a key.
BROADCAST_KEYS = 2_000_000
# Drops the shuffle files of a statement once it has ended.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Writes rows to the folders of up to so many partition values at once, without a sort.
OPEN_FOLDERS = {"spark.sql.maxConcurrentOutputFileWriters": "64"}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="courtside-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later uses see the same rows even if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def configured(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder: later uses scan it, and read no column they don't need.

    They read the same rows at the price of a scan, also after lost executors. The
    shuffle files of the write serve nothing after it, so they go at once: a job of many
    steps holds those of one step on its disks, not those of all.
    """
    path = scratch_path(df.sparkSession, name)
    with configured(df.sparkSession, DROP_SHUFFLES):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_nulls(written: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; of ``columns``, numbers and texts that hold no NULL are known not to.

    A file's columns may all be NULL as far as Spark knows, so that it plans ``NOT IN`` for
    the worst. ``written`` must be stored: the columns are read once to count their NULLs.
    """
    kinds = {f.name: f.dataType for f in written.schema if f.name in columns}
    plain = [c for c, kind in kinds.items() if isinstance(kind, T.NumericType | T.StringType)]
    if not plain:
        return written
    missing = written.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in plain]).first()
    full = [c for c in plain if missing[c] == 0]
    # Never replaces a value: Spark only sees that the result can't be NULL.
    blank = {c: F.lit("") if kinds[c] == T.StringType() else F.lit(0).cast(kinds[c]) for c in full}
    known = {c: F.coalesce(F.col(f"`{c}`"), value) for c, value in blank.items()}
    return written.withColumns(known) if known else written


def is_small(
    pinned: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether there are at most so many rows and bytes; the count stops one row later.

    The bytes bound any side; rows of a single column, a key, may be more than others by default.
    ``pinned`` must be cheap to read twice (a checkpoint or a stored table). Bytes are
    those of the values written as text.
    """
    if max_rows is None:
        max_rows = BROADCAST_KEYS if len(pinned.columns) == 1 else BROADCAST_ROWS
    texts = [F.col(f"`{c}`").cast("string") for c in pinned.columns]
    width = F.octet_length(F.concat_ws("", *texts))
    found = pinned.limit(max_rows + 1).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    )
    size = found.first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def broadcast_if_small(pinned: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; otherwise Spark decides."""
    return F.broadcast(pinned) if is_small(pinned, max_rows) else pinned


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of few splits to all cores; a scan of many is left as it is.

    Files below the split size would keep a handful of cores busy, however costly the
    work on their rows. Larger inputs already come in at least one split per core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
