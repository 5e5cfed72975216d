"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
_TABLE_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Bytes of words: ASCII letters and digits, and all of other characters.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def normalise(text: str) -> bytes:
    """Lower case, any white space as one blank, UTF-8."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def _codes(data: bytes) -> np.ndarray:
    """Every q-gram of ``data`` as a number: its eight bytes."""
    if len(data) < Q:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((len(data) - Q + 1,), dtype="<u8", buffer=data, strides=(1,))


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)


@dataclass
class Index:
    """Q-grams of benchmark items: sorted codes with the items and places they occur at.

    ``short`` has the numbers of the items that are searched exactly, by their text, and
    ``lengths`` how long those are.
    """

    ids: list
    texts: list[bytes]
    budgets: np.ndarray
    needed: np.ndarray
    codes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    present: np.ndarray
    short: dict[bytes, list[int]]
    lengths: list[int]

    @classmethod
    def of(cls, rows: list[tuple], edit_rate: float, min_chars: int) -> Index:
        ids, texts, budgets, needed = [], [], [], []
        codes, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)]
        short: dict[bytes, list[int]] = {}
        for key, text in rows:
            data = normalise(text or "")
            if not data:
                continue
            if len(data) < max(Q, min_chars):
                short.setdefault(data, []).append(len(ids))
                ids.append(key)
                texts.append(data)
                budgets.append(0)
                needed.append(0)
                continue
            grams = len(data) - Q + 1
            # The lemma: k edits destroy at most k * q of the item's q-grams. The budget is
            # kept so small that at least one shared q-gram is left.
            budget = min(int(edit_rate * len(data)), (grams - 1) // Q)
            codes.append(_codes(data))
            items.append(np.full(grams, len(ids)))
            places.append(np.arange(grams))
            ids.append(key)
            texts.append(data)
            budgets.append(budget)
            needed.append(grams - budget * Q)
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        present = np.zeros(1 << _TABLE_BITS, dtype=bool)
        present[_slot(every)] = True
        return cls(
            ids,
            texts,
            np.array(budgets, dtype=np.int64),
            np.array(needed, dtype=np.int64),
            every[order],
            np.concatenate(items)[order],
            np.concatenate(places)[order],
            present,
            short,
            sorted({len(data) for data in short}),
        )

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """Item number, first and last byte, distance, shared q-grams of each match's item."""
        data = normalise(text)
        if self.short:
            yield from self._exact(data)
        yield from self._near(data)

    def _exact(self, data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of each short item that stands between word boundaries."""
        letters = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = _WORD[letters]
        edge = ~(inside[:-1] & inside[1:])
        for length in self.lengths:
            if length > len(data):
                break
            seen = set()
            for begin in np.flatnonzero(edge[: len(edge) - length] & edge[length:]).tolist():
                part = data[begin : begin + length]
                if part in self.short and part not in seen:
                    seen.add(part)
                    for number in self.short[part]:
                        yield number, begin, begin + length, 0, max(0, length - Q + 1)

    def _near(self, data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        codes = _codes(data)
        at = np.flatnonzero(self.present[_slot(codes)])
        if not len(at):
            return
        left = np.searchsorted(self.codes, codes[at], "left")
        count = np.searchsorted(self.codes, codes[at], "right") - left
        total = int(count.sum())
        if not total:
            return
        starts = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        hit = starts + np.arange(total)
        item, place = self.items[hit], self.places[hit]
        diagonal = np.repeat(at, count) - place + (1 << 31)
        # Bands of 2w diagonals, one every w, where w is over the budget: the hits of a match
        # drift by at most the budget and so lie in one of the two bands that hold its first.
        width = self.budgets[item] + 1
        band = diagonal // width
        keys = np.concatenate([band, band - 1]) + (np.concatenate([item, item]) << 36)
        hits = np.concatenate([place, place])
        found, inverse, shared = np.unique(keys, return_inverse=True, return_counts=True)
        keep = shared >= self.needed[found >> 36]
        if not keep.any():
            return
        # A q-gram of the item counts once in a band.
        chosen = keep[inverse]
        pairs = np.unique(np.stack([inverse[chosen], hits[chosen]], axis=1), axis=0)
        shared = np.bincount(pairs[:, 0], minlength=len(found))
        items = found >> 36
        keep = shared >= self.needed[items]
        best: dict[int, tuple[int, int, int, int]] = {}
        for key, number, n in zip(found[keep], items[keep], shared[keep], strict=True):
            if number in best and best[number][0] == 0:
                continue
            width = int(self.budgets[number]) + 1
            low = int(key & ((1 << 36) - 1)) * width - (1 << 31)
            first = max(0, low - width)
            last = min(len(data), low + 2 * width + len(self.texts[number]) + width)
            item_text = self.texts[number]
            begin = data.find(item_text, first, last) - first
            distance, end = 0, begin + len(item_text)
            if begin < 0:
                distance, begin, end = banded_alignment(
                    item_text, data[first:last], low - first, 2 * width, int(self.budgets[number])
                )
            if distance <= self.budgets[number]:
                one = (distance, first + begin, first + end, int(n))
                if number not in best or one < best[number]:
                    best[int(number)] = one
        for number, (distance, begin, end, n) in sorted(best.items()):
            yield number, begin, end, distance, n


def banded_alignment(
    item: bytes, region: bytes, low: int, wide: int, budget: int
) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any part of ``region``, and that part's ends.

    Only cells on diagonals ``low - budget`` to ``low + wide + budget`` are filled; an
    alignment with ``budget`` edits that starts on diagonals ``low`` to ``low + wide``
    stays on them. Where the distance exceeds the budget it is only an upper bound.
    """
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    start = low - budget
    size = wide + 2 * budget + 1
    steps = np.arange(size)
    far = len(item) + len(region) + 1
    columns = start + steps
    valid = (columns >= 0) & (columns <= len(b))
    cost = np.where(valid, 0, far)
    origin = np.clip(columns, 0, len(b))
    for i in range(len(a)):
        columns = start + i + 1 + steps
        valid = (columns >= 0) & (columns <= len(b))
        letters = b[np.clip(columns - 1, 0, max(0, len(b) - 1))] if len(b) else np.zeros(size, np.uint8)
        across = cost + np.where((columns >= 1) & (letters == a[i]), 0, 1)
        across = np.where(columns >= 1, across, far)
        down = np.append(cost[1:], far) + 1
        best = np.where(down < across, down, across)
        came = np.where(down < across, np.append(origin[1:], 0), origin)
        best = np.where(valid, best, far)
        # A step to the right costs one: the running least of cost minus place.
        lifted = (best - steps) * (size + 1) + steps
        least = np.minimum.accumulate(lifted)
        source = least % (size + 1)
        cost = np.where(valid, least // (size + 1) + steps, far)
        origin = came[source]
    at = int(np.argmin(cost))
    return int(cost[at]), int(origin[at]), int(min(len(b), start + len(a) + at))


def _indexes(
    benchmark: DataFrame,
    edit_rate: float,
    min_chars: int,
    block_bytes: int,
    item_column: str,
    item_text_column: str,
) -> Iterator[Broadcast]:
    """The items' q-grams, broadcast in blocks of about ``block_bytes`` of text."""
    spark = benchmark.sparkSession
    listed = benchmark.select(
        F.col(item_column).cast("long").alias("_item"),
        F.col(item_text_column).cast("string").alias("_text"),
    ).where("_text IS NOT NULL")
    # Items without an id are searched too, unless an item with an id has their text.
    named = listed.where("_item IS NOT NULL")
    unnamed = listed.where("_item IS NULL").distinct().join(named.select("_text"), "_text", "left_anti")
    listed = named.unionByName(unnamed)
    total = listed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for block in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block)
        rows = [(r["_item"], r["_text"]) for r in part.orderBy("_item", "_text").collect()]
        yield spark.sparkContext.broadcast(Index.of(rows, edit_rate, min_chars))


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    edit_rate: float = 0.1,
    min_chars: int = 40,
    block_bytes: int = 16 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Which documents hold a benchmark item, within ``edit_rate`` edits per byte of it.

    One row per document and item: ``id_column``, ``item_column``, ``distance``,
    ``begin`` and ``end`` (bytes of the normalised text, see :func:`normalise`) of the
    nearest part and ``shared`` (q-grams). Whole texts are searched for whole items.

    The filter counts shared q-grams in overlapping bands of diagonals and keeps a band
    only if it holds as many as the lemma demands of a match; the rest is aligned in the
    band. Both are exact for the budget. Items of fewer than ``min_chars`` bytes are
    searched without edits, between word boundaries.

    Items are broadcast in blocks of about ``block_bytes`` of text, each searched in a pass
    of its own, so what is broadcast never grows with the tables. Null texts never match, nor do
    items with a null text; rows with a null id are searched like others. An item with a null
    id gives rows with a null ``item_column`` unless an item with an id has the same text. Repeated rows give repeated results, equal items one result each; an empty
    table gives no rows. Other columns are left out.
    """
    # Ids are text on the Python side, which would read a column with nulls as fractions.
    narrow = docs.select(
        F.col(id_column).cast("string").alias("_id"), F.col(text_column).cast("string").alias("_text")
    ).where("_text IS NOT NULL")
    schema = "_id string, _item string, distance int, begin bigint, end bigint, shared int"
    results = []
    for shared in _indexes(benchmark, edit_rate, min_chars, block_bytes, item_column, item_text_column):

        def search(batches: Iterator[pd.DataFrame], held=shared) -> Iterator[pd.DataFrame]:
            index = held.value
            for batch in batches:
                yield pd.DataFrame(
                    [
                        (doc, None if index.ids[number] is None else str(index.ids[number]), distance, begin, end, n)
                        for doc, text in zip(batch["_id"], batch["_text"], strict=True)
                        for number, begin, end, distance, n in index.matches(text)
                    ],
                    columns=[x.split()[0] for x in schema.split(", ")],
                )

        results.append(narrow.mapInPandas(search, schema))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.select(
        F.col("_id").cast("long").alias(id_column),
        F.col("_item").cast("long").alias(item_column),
        "distance",
        "begin",
        "end",
        "shared",
    )


def _without_items(shared: Broadcast):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for texts in batches:
            found = [next(index.matches(t), None) is None for t in texts]
            yield pd.Series(found, dtype=bool)

    return clean


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    edit_rate: float = 0.1,
    min_chars: int = 40,
    block_bytes: int = 16 << 20,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``docs`` without the rows whose text holds an item, see :func:`contaminations`.

    All columns are kept; null texts stay. No shuffle: each text is judged where it is.
    """
    kept = docs
    for shared in _indexes(benchmark, edit_rate, min_chars, block_bytes, item_column, item_text_column):
        kept = kept.where(_without_items(shared)(F.coalesce(F.col(text_column).cast("string"), F.lit(""))))
    return kept
