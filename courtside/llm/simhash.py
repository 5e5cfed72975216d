"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored
from courtside.llm.graph import components

# 64 bits in five blocks: two fingerprints that differ in at most three bits agree in at
# least two whole blocks, so each of the ten pairs of blocks is one table of buckets.
_EDGES = (0, 13, 26, 39, 52, 64)
_RADIUS = 3
# Fingerprints of a bucket that are compared in one piece.
_CHUNK = 4096


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """64 bits over shingles of words; 0 without words.

    A-Z are lower-cased, words are split at ASCII white space, shingles keep repeats and are
    joined by a blank; a text of fewer words is one shingle. A bit is 1 if it is set in
    more than half the hashes (XXH64, seed 42).
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = [(a, b - 1) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 65_536):
        part = hashes[begin : begin + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text", shingle: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` and ``_fp``, the fingerprint as a signed long.

    Null texts count as empty, whose fingerprint is 0. Whole texts are read.
    """

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint_of(t or "", shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.withColumn("_fp", fingerprint(text))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Fingerprints stored vertically: row b holds bit b of all of them, 64 to a word."""
    n = len(values)
    padded = np.zeros(-(-n // 64) * 64, dtype=np.uint64)
    padded[:n] = values
    planes = np.empty((64, len(padded) // 64), dtype=np.uint64)
    for b in range(64):
        bits = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(bits, bitorder="little").view(np.uint64)
    return planes


def within_radius(
    queries: np.ndarray, planes: np.ndarray, count: int, radius: int = _RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, stored) that differ in at most ``radius`` bits (3 at most).

    Distances of 64 stored fingerprints are counted at once in two carry-save bit counters
    and an overflow bit. Words all of whose distances exceed the radius are left out of
    the planes that follow; the comparison ends when none is left.
    """
    words = planes.shape[1]
    rows = np.repeat(np.arange(len(queries)), words)
    cols = np.tile(np.arange(words), len(queries))
    ones = np.zeros(len(rows), dtype=np.uint64)
    twos, over = ones.copy(), ones.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    if count % 64:  # places behind the last fingerprint count as far away
        over[cols == words - 1] = full << np.uint64(count % 64)
    limit = {0: lambda: ones | twos | over, 1: lambda: twos | over, 2: lambda: (ones & twos) | over}
    beyond = limit.get(radius, lambda: over)
    for b in range(64):
        wanted = np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        differ = planes[b][cols] ^ wanted[rows]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if b % 4 == 3:
            alive = beyond() != full
            if not alive.all():
                rows, cols, ones, twos, over = (x[alive] for x in (rows, cols, ones, twos, over))
            if not len(rows):
                break
    near = ~beyond()
    found = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(found)
    return rows[at], cols[at] * 64 + bit


def _roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest connected number of each of ``size`` numbers."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            again = root[root]
            if (again == root).all():
                break
            root = again
        if (root == before).all():
            return root


def _bucket_links(values: np.ndarray, other: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected inside one chunk, or between two chunks.

    Members of a component are linked as a tree with eight branches a node, so the number
    of links is that of members, and none has many.
    """
    everything = values if other is None else np.concatenate([values, other])
    stored_part = everything if other is None else other
    planes = bit_planes(stored_part)
    shift = 0 if other is None else len(values)
    lefts, rights = [], []
    for begin in range(0, len(values), 256):
        i, j = within_radius(values[begin : begin + 256], planes, len(stored_part))
        lefts.append(i + begin)
        rights.append(j + shift)
    root = _roots(len(everything), np.concatenate(lefts), np.concatenate(rights))
    order = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.diff(root[order], prepend=-1))
    for begin, end in zip(starts, [*starts[1:], len(order)], strict=True):
        members = everything[order[begin:end]]
        for i in range(1, len(members)):
            yield int(members[(i - 1) // 8]), int(members[i])


def near_links(fps: DataFrame, column: str = "_fp") -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints connected by differences of at most 3 bits.

    ``fps`` holds distinct fingerprints. Exact: ten tables of buckets, each on two of five
    blocks of bits. Buckets of more than ``_CHUNK`` members are cut, and each pair of parts
    is compared in a task of its own.
    """

    def table(pair: tuple[int, int]) -> Column:
        parts = [
            F.shiftrightunsigned(column, _EDGES[i]).bitwiseAND((1 << (_EDGES[i + 1] - _EDGES[i])) - 1)
            for i in pair
        ]
        return F.struct(parts[0].alias("x"), parts[1].alias("y"))

    tables = [table(pair) for pair in combinations(range(5), 2)]
    placed = fps.select(F.col(column).alias("_v"), F.posexplode(F.array(*tables)).alias("t", "_k"))
    keyed = placed.select("_v", "t", "_k.x", "_k.y")
    keys = ["t", "x", "y"]
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    dealt = salted_join(keyed, sizes, keys, ["_v"]).withColumn(
        "parts", F.ceil(F.col("n") / _CHUNK).cast("int")
    )
    part = F.pmod(F.xxhash64("_v"), F.col("parts")).cast("int")
    # Part i meets every part j: the task of (smaller, larger) gets both.
    pairs = dealt.withColumn("p", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    tasks = pairs.select(
        "_v",
        *keys,
        F.least("p", "other").alias("i"),
        F.greatest("p", "other").alias("j"),
        (F.col("p") > F.col("other")).alias("second"),
    )
    # Many small buckets share a partition of the Python side; a bucket's task stays whole.
    frame = tasks.withColumn("_g", F.xxhash64(*keys, "i", "j"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(part: pd.DataFrame) -> pd.DataFrame:
            links: list[tuple[int, int]] = []
            for _, rows in part.groupby([*keys, "i", "j"], sort=False):
                values = rows["_v"].to_numpy().view(np.uint64)
                second = rows["second"].to_numpy()
                if second.any():
                    if second.all():
                        continue
                    links.extend(_bucket_links(values[~second], values[second]))
                elif rows["i"].iloc[0] == rows["j"].iloc[0] and len(values) > 1:
                    links.extend(_bucket_links(values, None))
            found = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

        held: list[pd.DataFrame] = []
        for batch in batches:
            # Rows come sorted by group: all but the last group of a batch are complete.
            last = batch["_g"].iloc[-1]
            open_rows = batch["_g"] == last
            if not open_rows.all():
                yield flush(pd.concat([*held, batch[~open_rows]]))
                held = [batch[open_rows]]
            else:
                held.append(batch)
        if held:
            yield flush(pd.concat(held))

    return (
        frame.repartition("_g")
        .sortWithinPartitions("_g")
        .mapInPandas(link, "a bigint, b bigint")
        .distinct()
    )


def simhash_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
) -> DataFrame:
    """``id_column``, ``_fp`` and ``component_id`` (smallest id reachable) for every row.

    Fingerprints link at three or fewer differing bits, and components follow links.
    Equal fingerprints are one node, so copies cost nothing beyond their first. Null and
    empty texts have fingerprint 0 and are linked like any other. A null id never is the
    smallest unless all of its component are null. An empty table gives no rows; other
    columns are left out.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    marked = stored(fingerprints(narrow, "_text", shingle).select("_id", "_fp"), "fingerprints")
    nodes = stored(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "fingerprint-nodes")
    links = stored(near_links(nodes.select("_fp")), "fingerprint-links")
    labels = components(links, "fingerprint-components")
    named = nodes.join(labels.withColumnRenamed("node", "_fp"), "_fp", "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    answers = salted_join(named, least, ["_root"], ["_fp"]).select("_fp", "component_id")
    return salted_join(marked, answers, ["_fp"], ["_id"]).select(
        F.col("_id").alias(id_column), "_fp", "component_id"
    )
