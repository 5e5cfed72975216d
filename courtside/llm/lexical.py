"""Ranked lexical search: norm buckets of impact vectors, pruned by bounds, rescored in integers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from courtside.llm.common import stored

# Letters and digits of ASCII, in lower case, and every byte of other characters make terms.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)
# Very long texts are cut into terms in parts of about so many bytes.
_PART = 4 << 20
# Rows of a bucket: at most, and at least before a fall of the norm ends it.
_BUCKET, _SMALL_BUCKET = 4096, 256


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in parts."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Queries:
    """A block of items: the distinct terms of each as numbers, and those numbers' terms."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            found = {term for part in terms_of(text) for term in part}
            numbers = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found]
            if numbers:
                self.items.append((item, np.array(sorted(numbers), dtype=np.int64)))


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs of an array, one behind the other."""
    upto = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begins - upto, sizes)


class Bucket:
    """Impact vectors of similar length, by row and by coordinate."""

    def __init__(
        self,
        ids: list,
        ends: np.ndarray,
        terms: np.ndarray,
        impacts: np.ndarray,
        norms: np.ndarray,
        width: int,
    ) -> None:
        self.ids, self.ends, self.terms, self.impacts, self.norms = ids, ends, terms, impacts, norms
        sizes = np.diff(ends)
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), sizes)[order]
        self.values = impacts[order]
        here, first = np.unique(terms[order], return_index=True)
        self.list_ends = np.append(first, len(order))
        self.place = np.full(width, -1, dtype=np.int64)
        self.place[here] = np.arange(len(here))
        self.most = np.maximum.reduceat(self.values, first) if len(first) else self.values
        by_id = sorted(range(len(ids)), key=lambda i: _rank_order((0, ids[i] is None, ids[i])))
        self.rank = np.empty(len(ids), dtype=np.int64)
        self.rank[by_id] = np.arange(len(ids))

    def survivors(self, wanted: np.ndarray, least: int) -> np.ndarray:
        """Rows that may score ``least`` or more for the terms ``wanted``.

        Coordinates come by their largest value in the bucket. Once the largest values of
        those to come sum up to less than ``least``, a row without any coordinate so far
        is out. Of the others the rest is bounded by those sums, and by the number of
        coordinates to come and the length that the row has left (Cauchy-Schwarz).
        """
        at = self.place[wanted]
        at = at[at >= 0]
        if not len(at) or math.sqrt(len(at)) * self.norms[0] * (1 + 1e-9) < least:
            return np.zeros(0, dtype=np.int64)
        at = at[np.argsort(-self.most[at], kind="stable")]
        to_come = np.append(np.cumsum(self.most[at][::-1])[::-1], 0)
        if to_come[0] < least:
            return np.zeros(0, dtype=np.int64)
        reached = np.zeros(len(self.ids), dtype=np.int64)
        used = np.zeros(len(self.ids))
        for i, coordinate in enumerate(at):
            if to_come[i] < least:
                break
            run = slice(self.list_ends[coordinate], self.list_ends[coordinate + 1])
            rows, values = self.rows[run], self.values[run]
            reached[rows] += values
            used[rows] += values.astype(np.float64) ** 2
        else:
            return np.flatnonzero(reached >= least)
        rows = np.flatnonzero(reached)
        left = np.sqrt(np.maximum(self.norms[rows] ** 2 * (1 + 1e-9) - used[rows], 0) * (len(at) - i))
        rest = np.minimum(left * (1 + 1e-9) + 1, to_come[i])
        return rows[reached[rows] + rest >= least]

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        places = _runs(self.ends[rows], sizes)
        inside = np.zeros(len(self.place), dtype=bool)
        inside[wanted] = True
        parts = np.where(inside[self.terms[places]], self.impacts[places], 0)
        total = np.concatenate([[0], np.cumsum(parts)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def best(self, wanted: np.ndarray, least: int, keep: int) -> list[tuple[int, bool, object]]:
        """The best rows of at least ``least``: ``(-score, no id, id)`` in rank order."""
        rows = self.survivors(wanted, least)
        if not len(rows):
            return []
        scores = self.scores(rows, wanted)
        rows, scores = rows[scores >= least], scores[scores >= least]
        first = np.lexsort((self.rank[rows], -scores))[:keep]
        return [(-int(scores[i]), self.ids[rows[i]] is None, self.ids[rows[i]]) for i in first]


def _rank_order(row: tuple[int, bool, object]) -> tuple:
    """Sorts ``(-score, no id, id)``; rows without an id are never compared by it."""
    return row[0], row[1], 0 if row[1] else row[2]


def _bucket(part: pa.RecordBatch, width: int) -> Bucket:
    terms, impacts = part.column("_terms"), part.column("_impacts")
    ends = terms.offsets.to_numpy()
    return Bucket(
        part.column("_id").to_pylist(),
        ends.astype(np.int64) - int(ends[0]),
        terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        impacts.flatten().to_numpy(zero_copy_only=False),
        part.column("_norm").to_numpy(zero_copy_only=False),
        width,
    )


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Bucket]:
    """Buckets of rows that come by falling norm."""
    for batch in batches:
        norms = batch.column("_norm").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(norms):
            end = min(at + _BUCKET, len(norms))
            short = np.flatnonzero(norms[at:end] < norms[at] / 2)
            if len(short):
                end = min(end, at + max(int(short[0]), _SMALL_BUCKET))
            yield _bucket(batch.slice(at, end - at), width)
            at = end


def profiles(docs: DataFrame, queries: Queries) -> DataFrame:
    """Per document ``(_id, _text)`` with a term: its number of terms, and of each wanted one."""
    vocabulary = queries.vocabulary
    schema = T.StructType([
        T.StructField("_id", docs.schema["_id"].dataType),
        T.StructField("_n", T.LongType()),
        T.StructField("_terms", T.ArrayType(T.IntegerType())),
        T.StructField("_counts", T.ArrayType(T.LongType())),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("_text"):
                found: Counter = Counter()
                for part in terms_of(text.as_py() or b""):
                    found.update(map(number, part))
                sizes.append(found.total())
                found.pop(None, None)
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                schema.names,
            )

    return docs.mapInArrow(count, schema).where("_n > 0")


def weight(documents: int, holding: int) -> int:
    """How much a term counts that so many of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact_vectors(found: DataFrame, documents: int, length: int, weights: np.ndarray) -> DataFrame:
    """Per document its impact on each wanted term, and the length of that vector."""
    schema = T.StructType([
        T.StructField("_id", found.schema["_id"].dataType),
        T.StructField("_terms", T.ArrayType(T.IntegerType())),
        T.StructField("_impacts", T.ArrayType(T.LongType())),
        T.StructField("_norm", T.DoubleType()),
    ])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = batch.column("_terms"), batch.column("_counts")
            ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            # Python's numbers, as the product may need more than 64 bits.
            m = [10 + 90 * n * documents // length for n in batch.column("_n").to_pylist()]
            many = counts.flatten().to_numpy(zero_copy_only=False)
            spread = np.repeat(np.array(m, dtype=np.int64), np.diff(ends))
            parts = 1_000_000_000 * many // (1000 * many + 8 * spread)
            impacts = weights[terms.flatten().to_numpy(zero_copy_only=False)] * parts
            squares = impacts.astype(np.float64) ** 2
            # No row here is without terms.
            norms = np.sqrt(np.add.reduceat(squares, ends[:-1])) if len(m) else squares
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(impacts, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), terms, lists, pa.array(norms, pa.float64())], schema.names
            )

    return found.where("size(_terms) > 0").mapInArrow(weigh, schema)


def _search_block(docs: DataFrame, queries: Queries, keep: int, seeds: int) -> DataFrame:
    """``(_item, _id, score)``: at most ``keep`` rows per item and partition, the best among them."""
    kind = docs.schema["_id"].dataType
    id_type = to_arrow_type(kind)
    schema = T.StructType([
        T.StructField("_item", T.LongType()), T.StructField("_id", kind), T.StructField("score", T.LongType()),
    ])
    found = stored(profiles(docs, queries), "lexical-profiles")
    sums = found.agg(F.count("*").alias("documents"), F.sum("_n").alias("length")).first()
    holding = found.select(F.explode("_terms").alias("term")).groupBy("term").count()
    width = len(queries.vocabulary)
    weights = np.zeros(width, dtype=np.int64)
    for term, documents in holding.collect():  # one row per term of the block
        weights[term] = weight(sums["documents"], documents)
    vectors = impact_vectors(found, sums["documents"], sums["length"] or 1, weights)
    items = queries.items

    def search(least: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {item: [] for item, _ in items}
            needed = {item: least.get(item, 1) for item, _ in items}
            for bucket in _buckets(batches, width):
                for item, wanted in items:
                    new = bucket.best(wanted, needed[item], keep)
                    if new:
                        best[item] = sorted([*best[item], *new], key=_rank_order)[:keep]
                        if len(best[item]) == keep:
                            needed[item] = max(needed[item], -best[item][-1][0])
            rows = [(item, row[2], -row[0]) for item, ranked in best.items() for row in ranked]
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([r[1] for r in part], id_type),
                        pa.array([r[2] for r in part], pa.int64()),
                    ],
                    ["_item", "_id", "score"],
                )

        return run

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for at, batch in enumerate(batches):
            if at == 0 and batch.num_rows:
                norms = batch.column("_norm").to_numpy(zero_copy_only=False)
                bucket = _bucket(batch.take(pa.array(np.argsort(-norms)[:seeds])), width)
                for item, wanted in items:
                    best = bucket.best(wanted, 1, keep)
                    if len(best) == keep:
                        rows.append((item, -best[-1][0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
            ["_item", "score"],
        )

    # What enough rows of one partition reach bounds the ranks of all partitions from below.
    reached = vectors.mapInArrow(bounds, "_item bigint, score bigint")
    least = dict(reached.groupBy("_item").agg(F.max("score")).collect())
    ordered = vectors.sortWithinPartitions(F.desc("_norm"))
    return ordered.mapInArrow(search(least), schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    keep: int = 10,
    seeds: int = 1024,
    block_bytes: int = 4 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The ``keep`` documents that rank highest for each item: item, ``rank``, document, ``score``.

    Terms are runs of letters and digits and of all characters beyond ASCII; only A-Z is
    lower-cased. A document scores, for each distinct term of the item that it holds, the
    term's weight times a share that grows with its count and falls with the document's
    length (see :func:`weight` and :func:`impact_vectors`); all of it in integers. Rank 1
    scores highest; of equal scores the smaller id ranks first. Scores of 0 don't rank.

    Items are the stated query set. They are taken in blocks of ``block_bytes`` of text (an
    item of more is a block of its own), and each block is held against all documents in
    one pass over the texts; only counts of its terms are kept. Their impact vectors are
    ordered by length inside every partition and cut into buckets. For an item, a bucket
    falls by Cauchy-Schwarz, rows inside it by the bounds of single coordinates, and the
    rows left are scored exactly. Before that, the ``seeds`` longest vectors of each
    partition's first batch are searched: what ``keep`` of them reach bounds all ranks from
    below and leaves out no row that ranks. Nothing is shuffled but term counts, those
    bounds and the best rows of each partition.

    Null and empty texts have no terms: such documents neither rank nor count, such items
    give no rows. Null ids rank behind others of equal score. Repeated rows are documents,
    or items, of their own. Other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    numbered = items.select(
        F.col(item_column).alias("_name"), F.col(item_text_column).cast("binary").alias("_words")
    ).withColumn("_item", F.monotonically_increasing_id())
    numbered = stored(numbered, "lexical-items")
    narrow = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("binary").alias("_text"))
    blocks: list[DataFrame] = []
    block: list[tuple[int, bytes]] = []
    size = 0

    def run() -> None:
        queries = Queries(block)
        if queries.items:
            blocks.append(stored(_search_block(narrow, queries, keep, seeds), "lexical-found"))

    for row in numbered.select("_item", "_words").toLocalIterator():
        words = bytes(row["_words"] or b"")
        if block and size + len(words) > block_bytes:
            run()
            block, size = [], 0
        block.append((row["_item"], words))
        size += len(words)
    if block:
        run()
    if blocks:
        found = blocks[0]
        for more in blocks[1:]:
            found = found.unionByName(more)
    else:
        schema = "_item bigint, score bigint"
        found = spark.createDataFrame([], schema).withColumn("_id", F.lit(None).cast(narrow.schema["_id"].dataType))
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.join(numbered.select("_item", "_name"), "_item").select(
        F.col("_name").alias(item_column), "rank", F.col("_id").alias(id_column), "score"
    )
