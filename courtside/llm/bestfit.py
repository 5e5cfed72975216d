"""Bounded-space online best-fit of whole tokenised documents into sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import stored
from courtside.llm.words import WordEncoder

OUTPUT = (
    "doc_id string, piece bigint, start bigint, length bigint, ids binary, "
    "sequence_id bigint, offset bigint, leftover boolean"
)
MOVES = "sequence_id bigint, _to bigint, _base bigint"
# A partition's own sequences are numbered below this; the partition number stands above.
_PER_PARTITION = 1 << 36
# Pieces placed together, the longest first.
_BLOCK = 1024


class Bins:
    """At most ``slots`` open bins of ``size``, found by their free space.

    Bit ``r`` of one integer is set if some open bin has exactly ``r`` free places, so the
    tightest bin for a piece is the lowest set bit from its length upwards, and the fullest
    bin is the lowest set bit of all. Of bins with equal space the last one is taken.
    """

    def __init__(self, size: int, slots: int) -> None:
        self.size, self.slots = size, slots
        self.rooms = 0
        self.with_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = 0
        self.made = 0

    def _take(self, room: int) -> int:
        bins = self.with_room[room]
        number = bins.pop()
        if not bins:
            self.rooms &= ~(1 << room)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """The bin and the offset of a piece, and the bins that close because of it."""
        closed = []
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            if self.open >= self.slots:
                closed.append(self._take((self.rooms & -self.rooms).bit_length() - 1))
            room, number = self.size, self.made
            self.made += 1
        left = room - length
        if left:
            self.with_room[left].append(number)
            self.rooms |= 1 << left
            self.open += 1
        else:
            closed.append(number)
        return number, self.size - room, closed


def _cut(doc: object, ids: np.ndarray, end: bytes, size: int) -> Iterator[tuple]:
    """``(doc, piece, start, length, ids)`` of a document: ``size`` ids each, then the rest."""
    raw = ids.tobytes() + end
    total = len(raw) // 4
    for piece, start in enumerate(range(0, total, size)):
        part = raw[4 * start : 4 * (start + size)]
        yield doc, piece, start, len(part) // 4, part


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split()[0] for part in OUTPUT.split(", ")])


def best_fit(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 0,
    slots: int = 512,
    merge_partitions: int = 256,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack documents into few sequences of at most ``size`` tokens; one row per piece.

    A document is its token ids (``tokenizer``: a file of the ``tokenizers`` library), then
    ``end_id``. Only documents of more than ``size`` ids are cut, every ``size`` ids.
    Columns: ``doc_id``, ``piece`` (from 0), ``start`` (its document's ids before the
    piece), ``length``, ``ids`` (unsigned 32-bit little-endian), ``sequence_id`` (unique,
    not gapless) and ``offset`` (in the sequence, gapless from 0).

    Every partition keeps at most ``slots`` bins open, see :class:`Bins`. Pieces come in
    blocks of 1,024, the longest of a block first, and each goes into the open bin that it
    leaves the least room in. If it fits in none and all are open, the fullest closes. A
    piece's ids stay in memory only until its bin closes: memory is bounded by the bins, a
    block and the longest text. The bins still open at a partition's end are placed into
    one another whole, by the same rule, those of ``merge_partitions`` neighbouring
    partitions in one task: it sees their fill only, ``slots`` numbers a partition, and the
    pieces of bins that move get their new places by a join.

    Null and empty texts are the end id alone. Null ids and repeated rows stay documents of
    their own; an empty table gives no rows. Other columns are left out. A partition that
    is computed again gives the same rows, as nothing depends on time or other partitions.
    """

    end = np.array([end_id], dtype="<u4").tobytes()

    def pack_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(tokenizer)
        first = TaskContext.get().partitionId() * _PER_PARTITION
        bins = Bins(size, slots)
        held: dict[int, list[tuple]] = {}
        done: list[tuple] = []

        def place(block: list[tuple]) -> None:
            for piece in sorted(block, key=lambda p: -p[3]):
                number, offset, closed = bins.place(piece[3])
                row = (*piece, first + number, offset)
                held.setdefault(number, []).append(row)
                for gone in closed:
                    done.extend((*r, False) for r in held.pop(gone))

        block: list[tuple] = []
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            docs_of = batch["doc_id"].tolist()
            for at, ids in encoder.encode(texts):
                for piece in _cut(docs_of[at], ids, end, size):
                    block.append(piece)
                    if len(block) == _BLOCK:
                        place(block)
                        block = []
                if len(done) >= 4 * _BLOCK:
                    yield _frame(done)
                    done.clear()
        place(block)
        done.extend((*row, True) for rows in held.values() for row in rows)
        for at in range(0, len(done), 4 * _BLOCK):
            yield _frame(done[at : at + 4 * _BLOCK])

    def merge_group(frame: pd.DataFrame) -> pd.DataFrame:
        bins, of_bin, moves = Bins(size, 1 << 60), {}, []
        frame = frame.sort_values(["used", "sequence_id"], ascending=[False, True])
        for sequence, used in zip(frame["sequence_id"], frame["used"], strict=True):
            number, offset, _ = bins.place(int(used))
            # A merged sequence takes the number of the first of its bins.
            moves.append((sequence, of_bin.setdefault(number, sequence), offset))
        return pd.DataFrame(moves, columns=["sequence_id", "_to", "_base"])

    # Ids are text on the Python side, which would read a column with nulls as fractions.
    narrow = docs.select(
        F.col(id_column).cast("string").alias("doc_id"),
        F.col(text_column).cast("string").alias("text"),
    )
    packed = stored(narrow.mapInPandas(pack_partition, OUTPUT), "best-fit")
    left = packed.where("leftover").drop("leftover")
    fill = left.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    group = F.shiftright("sequence_id", 36) / F.lit(merge_partitions)
    moves = fill.groupBy(F.floor(group).alias("_group")).applyInPandas(merge_group, MOVES)
    moved = left.join(moves, "sequence_id").select(
        "doc_id", "piece", "start", "length", "ids",
        F.col("_to").alias("sequence_id"), (F.col("_base") + F.col("offset")).alias("offset"),
    )
    pieces = packed.where("NOT leftover").drop("leftover").unionByName(moved)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_column].dataType))
