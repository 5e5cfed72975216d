"""Bounded-space online packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import stored
from courtside.llm.tokens import Encoder

OUTPUT = (
    "doc_id string, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, leftover boolean"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.string()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("leftover", pa.bool_()),
    ]
)
# A partition's own sequences are numbered below this; the partition number stands above.
_PER_PARTITION = 1 << 36


class Windows:
    """A fixed number of open windows; full ones leave as lists of pieces.

    A piece goes into the open window it fits best (least room left). If it fits in none
    and all windows are open, the fullest leaves. Before that, the fullest is topped up
    with the head of the piece if its gap is at least ``top_up`` tokens, so that a window
    never leaves with a larger gap than that.
    """

    def __init__(self, size: int, slots: int, top_up: int) -> None:
        self.size, self.slots, self.top_up = size, slots, top_up
        self.open: list[list[tuple]] = []
        self.room: list[int] = []

    def _leave(self, at: int) -> list[tuple]:
        self.room.pop(at)
        return self.open.pop(at)

    def add(self, doc: object, ids: np.ndarray, start: int = 0) -> Iterator[list[tuple]]:
        """Place ``ids`` of a document, whose first one is number ``start`` there."""
        total = start + len(ids)
        while len(ids) >= self.size:
            yield [(doc, start, ids[: self.size], total)]
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            fitting = [(room, at) for at, room in enumerate(self.room) if room >= len(ids)]
            if fitting:
                room, at = min(fitting)
            elif len(self.open) < self.slots:
                self.open.append([])
                self.room.append(self.size)
                at = len(self.open) - 1
            else:
                room, at = min((room, at) for at, room in enumerate(self.room))
                if room >= self.top_up:
                    self.open[at].append((doc, start, ids[:room], total))
                    ids, start = ids[room:], start + room
                yield self._leave(at)
                continue
            self.open[at].append((doc, start, ids, total))
            self.room[at] -= len(ids)
            if not self.room[at]:
                yield self._leave(at)
            return

    def merge(self) -> tuple[list[list[tuple]], list[tuple]]:
        """Join the windows still open: full sequences, and the pieces of one that isn't."""
        whole: list[list[tuple]] = []
        current: list[tuple] = []
        used = 0
        for window in self.open:
            for doc, start, ids, total in window:
                while len(ids):
                    head = ids[: self.size - used]
                    current.append((doc, start, head, total))
                    ids, start, used = ids[len(head) :], start + len(head), used + len(head)
                    if used == self.size:
                        whole.append(current)
                        current, used = [], 0
        self.open, self.room = [], []
        return whole, current


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in OUTPUT.split(", ")]
    return pd.DataFrame(rows, columns=names)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _rows(pieces: list[tuple], sequence: int, leftover: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in pieces:
        yield doc, start, len(ids), ids.tobytes(), total, sequence, offset, leftover
        offset += len(ids)


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    slots: int = 64,
    top_up: int = 32,
    merge_partitions: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most ``size`` tokens; one row per piece.

    A document is its token ids (``tokenizer``: a file of the ``tokenizers`` library), then
    ``end_id``. Columns: ``doc_id``, ``start`` (its document's ids before the piece),
    ``length``, ``ids`` (unsigned 32-bit little-endian), ``doc_tokens``, ``sequence_id``
    (unique, not gapless) and ``offset`` (in the sequence, gapless from 0).

    Every partition keeps ``slots`` windows open, see :class:`Windows`: memory is bounded
    by them and by the longest text. What is still open at a partition's end is joined to
    full sequences and less than one window of leftovers. Those of ``merge_partitions``
    neighbouring partitions are joined in the same way, so one sequence of each such group
    stays short, and a task sees at most that many windows.

    Null and empty texts are the end id alone. Null ids and repeated rows stay documents of
    their own; an empty table gives no rows. Other columns are left out.
    """

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        windows = Windows(size, slots, top_up)
        sequence = TaskContext.get().partitionId() * _PER_PARTITION
        for batch in batches:
            rows: list[tuple] = []
            texts = encoder.encode_all(batch.column("text"), end_id)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                for pieces in windows.add(doc, ids):
                    rows.extend(_rows(pieces, sequence, False))
                    sequence += 1
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        whole, rest = windows.merge()
        rows = []
        for pieces in whole:
            rows.extend(_rows(pieces, sequence, False))
            sequence += 1
        rows.extend(_rows(rest, sequence, True))
        if rows:
            yield _batch(rows)

    def merge_group(frame: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(size, 1 << 30, 0)
        frame = frame.sort_values(["sequence_id", "offset"])
        sequence = int(frame["sequence_id"].iloc[0])
        for row in frame.itertuples():
            ids = np.frombuffer(row.ids, "<u4")
            windows.open.append([(row.doc_id, row.start, ids, row.doc_tokens)])
        whole, rest = windows.merge()
        rows: list[tuple] = []
        for pieces in [*whole, rest]:
            rows.extend(_rows(pieces, sequence, True))
            sequence += 1
        return _frame(rows)

    # Ids are text on the Python side, which would read a column with nulls as fractions.
    narrow = docs.select(
        F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    packed = stored(narrow.mapInArrow(pack_partition, OUTPUT), "packed")
    partition = F.col("sequence_id") / F.lit(float(_PER_PARTITION))
    group = F.floor(F.floor(partition) / F.lit(merge_partitions))
    merged = (
        packed.where("leftover")
        .groupBy(group.alias("_group"))
        .applyInPandas(merge_group, OUTPUT)
    )
    pieces = packed.where("NOT leftover").unionByName(merged).drop("leftover")
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
