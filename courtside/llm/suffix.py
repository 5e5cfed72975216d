"""Suffix-array dedup: bytes of long strings that occur more than once are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored

# Bytes of the grams whose least hash in a window names the window's anchor.
GRAM = 32
# Text bytes a shard's suffix array is built over, about: its arrays should fit a cache.
SHARD_BYTES = 256 << 10
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` bytes of ``data``: a rolling polynomial, then mixed."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mixed((sums[length:] - sums[:-length]) * down[: len(data) - length + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, by least of blocks from both ends."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values) - width + 1], ahead[width - 1 : len(values)])


def segments(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: its hash, first start, number of starts.

    A window of ``length`` bytes is named by the least gram hash in it. Equal windows have
    equal anchors, wherever they stand, so only segments of one anchor need comparing. The
    fourth array tells whether the anchor's gram is the least one at several places of the
    text: then a segment may repeat windows of its own.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    grams = window_hashes(np.frombuffer(data, np.uint8), GRAM)
    width = length - GRAM + 1
    least = sliding_least(grams, width)
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    # A gram is the least of one of its windows if the largest of their leasts is its hash.
    edge = np.full(width - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    anchors = grams[~sliding_least(np.concatenate([edge, ~least, edge]), width) == grams]
    values, places = np.unique(anchors, return_counts=True)
    several = places[np.searchsorted(values, least[begins])] > 1
    return least[begins], begins, np.diff(np.append(begins, len(least))), several


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the order of their suffixes to ``depth`` bytes, and the rank of each start.

    Refinement in the manner of Larsson and Sadakane: ranks by the first eight bytes, then
    doubled; each round sorts again only the groups that are not single yet, by the rank
    of the suffix one step further on. The last round steps no further than ``depth``, so two
    suffixes have one rank if and only if they are alike to exactly ``depth`` bytes.
    """
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    # Bytes 0 to 254 of UTF-8 texts plus one fit in a byte, with 0 for the end.
    code = np.zeros(n, dtype=np.uint64)
    for i in range(min(8, depth)):
        code = (code << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(code)
    ordered = code[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # A group's rank is its first place in the order.
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, sizes)
    step = 8
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while step < depth and len(places):
        starts = order[places]
        further = starts + min(step, depth - step)
        next_rank = np.where(further < n, rank[np.minimum(further, n - 1)], -1) + 1
        group = rank[starts]
        key = (group.astype(np.uint64) << np.uint64(32)) | next_rank.astype(np.uint64)
        sort = np.argsort(key)
        starts, key = starts[sort], key[sort]
        order[places] = starts
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(places)))
        rank[starts] = np.repeat(places[first], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes each suffix has in common with the one before it in ``order``, up to ``limit``.

    Kasai's observation, over text places: the common prefix of a start is at least that of
    the start before it less one, and exactly that where both suffixes are preceded by the
    same byte. Only the other places are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    starts = np.arange(n)
    inherits = (before > 0) & (starts > 0)
    inherits[inherits] = data[starts[inherits] - 1] == data[before[inherits] - 1]
    # The pair one to the left must be neighbours too.
    inherits[1:] &= before[:-1] == before[1:] - 1
    own = np.flatnonzero(~inherits & (before >= 0))
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    words = np.ndarray((n,), "<u8", buffer=padded.data, strides=(1,))
    size = np.zeros(n, dtype=np.int64)
    here, there = own, before[own]
    at = 0
    active = np.arange(len(own))
    found = np.zeros(len(own), dtype=np.int64)
    while len(active):
        i, j = here[active] + at, there[active] + at
        inside = (i < n) & (j < n)
        differ = np.ones(len(active), dtype=np.uint64)
        differ[inside] = words[i[inside]] ^ words[j[inside]]
        ended = differ != 0
        low = differ & (~differ + np.uint64(1))
        same = np.where(inside, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8, 0)
        found[active[ended]] = at + same[ended]
        found[active[~ended]] = at + 8
        active = active[~ended]
        at += 8
    size[own] = np.minimum(found, n - np.maximum(here, there))
    # Inherited: one less for every place after the last one compared.
    source = np.where(inherits, -1, starts)
    source = np.maximum.accumulate(source)
    size = np.where(inherits, np.maximum(0, size[np.maximum(source, 0)] - (starts - source)), size)
    return np.minimum(size, limit)[order]


def repeated_windows(
    texts: list[bytes], counts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments ``texts`` by their place in the shard's suffix array.

    Returns the segment and the start in it of every window, its class (equal windows share
    one), and whether the class holds several.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order, rank = suffix_array(data, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(data)) - begins[owner]
    window = inside < counts[owner]
    starts = order
    valid = window[starts]
    # Suffixes of one rank have at least ``length`` bytes in common.
    classes = rank[starts][valid]
    chosen = starts[valid]
    several = np.bincount(classes, minlength=1)[classes] > 1
    return owner[chosen], inside[chosen], classes, several


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts as runs: first, and one behind the last."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + 1


def _segment_table(docs: DataFrame, length: int) -> DataFrame:
    schema = "k binary, anchor bigint, digest bigint, start int, n int, inner boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys: list[bytes] = []
            parts: list[tuple[np.ndarray, ...]] = []
            for key, text in zip(batch.column("k").to_pylist(), batch.column("data").to_pylist(), strict=True):
                anchor, start, n, inner = segments(text, length)
                if len(anchor):
                    digest = xxhash.xxh3_64_intdigest
                    view = memoryview(text)
                    hashed = [
                        digest(view[a : a + m + length - 1])
                        for a, m in zip(start.tolist(), n.tolist(), strict=True)
                    ]
                    parts.append((anchor, np.array(hashed, dtype=np.uint64), start, n, inner))
                    keys.extend([key] * len(anchor))
            if keys:
                anchor, digest, start, n, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array(anchor.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(inner),
                    ],
                    names=["k", "anchor", "digest", "start", "n", "inner"],
                )

    return docs.select("k", "data").mapInArrow(cut, schema)


def _texts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` segments (k, start, n and more) with their bytes."""
    extra = [c for c in wanted.columns if c not in ("k", "start", "n")]
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("start", "n", *extra)).alias("parts"))
    cut = docs.join(lists, "k").select("data", F.explode("parts").alias("p"))
    return cut.select(
        "p.*", F.substring("data", F.col("p.start") + 1, F.col("p.n") + F.lit(length - 1)).alias("bytes")
    )


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """``k``, ``a``, ``b``: runs of window starts (a to b - 1) whose string occurs elsewhere too.

    ``docs`` has a key ``k`` and ``data`` (binary); rows of equal key hold equal data.
    """
    table = stored(_segment_table(docs, length), "segments")
    # Copies of a segment meet in one row before anything is shuffled by anchor.
    kinds = table.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"),
        F.min(F.struct("k", "start", "n")).alias("at"),
        F.max("inner").alias("inner"),
    )
    kinds = stored(kinds.select("anchor", "digest", "copies", "inner", "at.*"), "segment-kinds")
    anchors = kinds.groupBy("anchor").agg(
        F.count("*").alias("kinds"),
        F.sum(F.col("n") + F.lit(length - 1)).alias("size"),
        F.max("inner").alias("within"),
    )
    compared = anchors.where("kinds > 1 OR within")
    shared = salted_join(kinds, compared, ["anchor"], ["digest"])
    total = shared.agg(F.sum(F.col("n") + F.lit(length - 1))).first()[0] or 0
    shards = 1 + int(total) // SHARD_BYTES
    # An anchor with more text than a shard should hold is dealt over several.
    parts = F.ceil(F.col("size") / F.lit(SHARD_BYTES)).cast("int")
    part = F.pmod(F.col("digest"), parts).cast("int")
    dealt = shared.withColumn("parts", parts).withColumn(
        "shard", F.pmod(F.xxhash64("anchor", part), F.lit(shards)).cast("int")
    )
    texts = _texts_of(
        docs, dealt.select("k", "start", "n", "anchor", "digest", "copies", "parts", "shard"), length
    )
    rows = "anchor bigint, digest bigint, parts int, cell int, a int, b int, run binary"

    def in_shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["anchor", "digest"]).sort_values(["anchor", "digest"])
        data = [bytes(x) for x in frame["bytes"]]
        counts = frame["n"].to_numpy().astype(np.int64)
        segment, inside, classes, several = repeated_windows(data, counts, length)
        out: list[tuple] = []
        anchor, digest = frame["anchor"].to_numpy(), frame["digest"].to_numpy()
        parts = frame["parts"].to_numpy()
        place = np.concatenate([[0], np.cumsum(counts)[:-1]])
        flat = np.sort((place[segment] + inside)[several])
        owner = np.repeat(np.arange(len(counts)), counts)
        for s, part in _by_owner(flat, owner):
            for a, b in zip(*_ranges(part - place[s]), strict=True):
                out.append((anchor[s], digest[s], 1, 0, a, b, None))
        # Anchors in several shards: sorted runs of one window of each class, for merging.
        split = np.flatnonzero(parts > 1)
        if len(split):
            hashes = np.zeros(int(counts.sum()), dtype=np.uint64)
            for s in split:
                hashes[place[s] : place[s] + counts[s]] = window_hashes(
                    np.frombuffer(data[s], np.uint8), length
                )
            wanted = (parts > 1)[segment]
            keep = wanted & np.concatenate([[True], classes[1:] != classes[:-1]])[: len(classes)]
            # A class may mix anchors only by chance of equal windows, which share one.
            at = place[segment[keep]] + inside[keep]
            lone = ~several[keep]
            for s in np.unique(anchor[split]):
                mine = anchor[owner[at]] == s
                cells = int(parts[np.flatnonzero(anchor == s)[0]])
                h, where, single = hashes[at[mine]], at[mine], lone[mine]
                order = np.argsort(h)
                h, where, single = h[order], where[order], single[order]
                bounds = np.array([c * (1 << 64) // cells for c in range(1, cells)], dtype=np.uint64)
                edges = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                for cell in range(cells):
                    i, j = edges[cell], edges[cell + 1]
                    if i < j:
                        body = np.stack(
                            [
                                h[i:j],
                                digest[owner[where[i:j]]].view(np.uint64),
                                ((where[i:j] - place[owner[where[i:j]]]) * 2 + single[i:j]).astype(np.uint64),
                            ]
                        )
                        out.append((s, 0, cells, cell, 0, 0, body.tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in rows.split(", ")])

    found = stored(
        texts.groupBy("shard").applyInPandas(in_shard, rows), "segment-matches"
    )
    merged = (
        found.where("run IS NOT NULL")
        .groupBy("anchor", "cell")
        .applyInPandas(_merge_runs, "anchor bigint, digest bigint, a int, b int")
    )
    near = found.where("run IS NULL").select("anchor", "digest", "a", "b").unionByName(merged)
    whole = kinds.where("copies > 1").select("anchor", "digest", F.lit(0).alias("a"), F.col("n").alias("b"))
    copied = kinds.where("copies > 1").select("anchor", "digest")
    near = near.join(copied, ["anchor", "digest"], "left_anti")
    flags = near.unionByName(whole).groupBy("anchor", "digest").agg(
        F.collect_list(F.struct("a", "b")).alias("spans")
    )
    placed = salted_join(table, flags, ["anchor", "digest"], ["k", "start"])
    return placed.select("k", "start", F.explode("spans").alias("s")).select(
        "k", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")
    )


def _by_owner(flat: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted numbers of windows, grouped by the segment they belong to."""
    if not len(flat):
        return
    whose = owner[flat]
    begins = np.flatnonzero(np.diff(whose, prepend=-1))
    for i, j in zip(begins, [*begins[1:], len(flat)], strict=True):
        yield int(whose[i]), flat[i:j]


def _merge_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows, single in their own shard, that occur in another shard's run too.

    Every sorted run is looked up by binary search in the merged runs before it; windows
    found on either side are repeated, the others are merged in.
    """
    anchor = int(frame["anchor"].iloc[0])
    merged = np.zeros((3, 0), dtype=np.uint64)
    hits: list[np.ndarray] = []
    for body in frame["run"]:
        run = np.frombuffer(body, np.uint64).reshape(3, -1)
        at = np.searchsorted(merged[0], run[0])
        known = np.zeros(run.shape[1], dtype=bool)
        inside = at < merged.shape[1]
        known[inside] = merged[0][at[inside]] == run[0][inside]
        hits += [run[:, known], merged[:, at[known]]]
        merged = np.insert(merged, at[~known], run[:, ~known], axis=1)
    found = np.unique(np.concatenate(hits, axis=1), axis=1)
    found = found[:, (found[2] & np.uint64(1)) == 1]
    digest = found[1].view(np.int64)
    start = (found[2] >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((start, digest))
    digest, start = digest[order], start[order]
    out: list[tuple] = []
    begins = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(digest) else []
    for i, j in zip(begins, [*begins[1:], len(digest)], strict=True) if len(digest) else ():
        for a, b in zip(*_ranges(start[i:j]), strict=True):
            out.append((anchor, int(digest[i]), int(a), int(b)))
    return pd.DataFrame(out, columns=["anchor", "digest", "a", "b"])


def removed_spans(spans: list, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of window starts as maximal runs of covered bytes."""
    if not len(spans):
        return np.zeros(0, int), np.zeros(0, int)
    pairs = np.array(sorted((s["a"], s["b"] + length - 1) for s in spans))
    top = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > top[:-1]])
    begins = pairs[new, 0]
    ends = top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]
    return begins, np.minimum(ends, size)


def drop_repeats(
    docs: DataFrame,
    length: int = 400,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts elsewhere too.

    Columns: ``id_column``, ``kept`` (binary: the remaining bytes joined), ``n_bytes``,
    ``begins`` and ``ends`` (maximal removed runs). Texts are UTF-8 bytes; "elsewhere" is any
    other start in any row, overlaps in the same text included, judged on the input. A cut
    may split a character, so the result is binary.

    Null texts count as empty, and nothing is removed from texts shorter than ``length``.
    Rows of equal id and text are two documents, so each one's strings occur in the other.
    An empty table gives no rows; other columns are left out.

    Equal windows have equal anchors (:func:`segments`), and only segments whose anchor
    occurs in several are looked at: copies of a whole segment are counted, the others go to
    shards by anchor, where a suffix array (:func:`suffix_array`) sorted to ``length`` bytes
    finds equal windows by their ranks. An anchor with more text than a shard is dealt over several, whose
    sorted runs are merged by binary search.
    """
    narrow = docs.select(
        F.col(id_column).cast("string").alias("_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("data"),
    )
    keyed = narrow.withColumn(
        "k", F.unhex(F.md5(F.concat(F.coalesce("_id", F.lit("")), F.lit("|"), F.col("data"))))
    )
    long = keyed.where(F.octet_length("data") >= length)
    ranges = repeated_ranges(long.select("k", "data"), length)
    spans = ranges.groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, data, spans in zip(batch["_id"], batch["data"], batch["spans"], strict=True):
                begins, ends = removed_spans(spans if spans is not None else [], length, len(data))
                view = bytes(data)
                edges = zip([0, *ends.tolist()], [*begins.tolist(), len(view)], strict=True)
                kept = b"".join(view[i:j] for i, j in edges)
                out.append((doc, kept, len(view), begins.tolist(), ends.tolist()))
            yield pd.DataFrame(out, columns=["_id", "kept", "n_bytes", "begins", "ends"])

    schema = "_id string, kept binary, n_bytes bigint, begins array<bigint>, ends array<bigint>"
    return (
        keyed.join(spans, "k", "left")
        .select("_id", "data", "spans")
        .mapInPandas(remove, schema)
        .withColumn("_id", F.col("_id").cast("long"))
        .withColumnRenamed("_id", id_column)
    )

