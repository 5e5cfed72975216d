"""Near-duplicate texts: an exact set-similarity join of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored
from courtside.llm.graph import components
from courtside.llm.lines import _mix

# Shingles are counted in this many hashed buckets. The counts only order shingles, so
# a rough count costs time and never a pair.
_BUCKET_BITS = 20
# Counts of a task that are passed on: several times the mean, and at least this many.
_OFTEN = 16
# Shingles counted at once.
_SLICE = 1 << 21
# Texts under one shingle that are paired in one piece.
_CHUNK = 1024
# Sets that a task remembers so as to write each one's prefix once.
_SEEN = 200_000


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``shingle`` words.

    Words are those of ``simhash.fingerprint_of``: A-Z lower-cased, split at ASCII white
    space. A text of fewer words is one shingle, a text without words has none.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + count]
    return np.unique(_mix(total, 0x5851F42D4C957F2D))


def parity_bits(hashed: np.ndarray) -> np.ndarray:
    """For each bit place whether an odd number of ``hashed`` falls on it, as 64-bit words.

    There are as many places as members or more, a power of two and at least 64. Two sets
    differ in no more bits than there are members that only one of them has.
    """
    places = max(64, 1 << (len(hashed) - 1).bit_length()) if len(hashed) else 64
    odd = np.bincount((hashed & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """The magnitude of the count of shingles in each bucket, 0 for most of them."""
    shift = np.uint64(64 - _BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _BUCKET_BITS, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append((shingle_hashes(text, shingle) >> shift).astype(np.int32))
                size += len(held[-1])
                if size > _SLICE:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        often = np.flatnonzero(counts >= max(_OFTEN, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(often.astype(np.int32)), pa.array(counts[often])], names=["bucket", "n"]
        )

    found = docs.select("_text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n"))
    ranks = np.zeros(1 << _BUCKET_BITS, dtype=np.uint8)
    for part in found.toArrow().to_batches():
        ranks[part.column(0).to_numpy()] = np.log2(part.column(1).to_numpy()).astype(np.uint8)
    return ranks


def _marked(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``_id``, ``_hash``, the set's key ``node``, size ``n`` and ``bits``, and its prefix.

    Shingles are ordered by their bucket's count, rarest first (ties by hash); the prefix
    is as long as two similar sets need to share a shingle in it. It is left empty where
    the task had the same set before. ``bits`` are those of ``parity_bits``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))
    ids = docs.schema["_id"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ranks = shared.value
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, prefixes, bits = [], [], [], []
            for text in batch.column("_text").to_pylist():
                hashed = shingle_hashes(text, shingle)
                n = len(hashed)
                node = xxhash.xxh64_intdigest(hashed.tobytes(), 42)
                long = 0
                if n and node not in seen:
                    seen.add(node)
                    long = n - int(np.ceil(similarity * n - 1e-9)) + 1
                    rank = ranks[(hashed >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)]
                    hashed = hashed[np.argsort(rank, kind="stable")]
                nodes.append(node)
                sizes.append(n)
                prefixes.append(hashed[:long])
                bits.append(parity_bits(hashed))
            if len(seen) > _SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_hash"),
                    pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(sizes, dtype=np.int32)),
                    _lists(prefixes),
                    _lists(bits),
                ],
                names=["_id", "_hash", "node", "n", "prefix", "bits"],
            )

    schema = (
        f"_id {ids.dataType.simpleString()}, _hash bigint, node bigint, n int, "
        "prefix array<bigint>, bits array<bigint>"
    )
    return docs.select("_id", "_hash", "_text").mapInArrow(mark, schema)


def _least(total: Column, similarity: float) -> Column:
    """Least overlap of two similar sets of ``total`` shingles together."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * total - 1e-9)


def _possible(a: str, b: str, similarity: float) -> Column:
    """Length and positional filter for entries (n, node, pos) ``a`` and ``b`` of one shingle."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (small >= similarity * large - 1e-9) & (left >= _least(small + large, similarity))


def _pairs(frame: DataFrame, a: str, b: str, similarity: float) -> DataFrame:
    """Distinct pairs of different nodes that may be similar."""
    return (
        frame.where(F.col(f"{a}.node") != F.col(f"{b}.node"))
        .where(_possible(a, b, similarity))
        .select(
            F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")
        )
        .distinct()
    )


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _differing(x: str, y: str) -> Column:
    """In how many bits ``x`` and ``y`` differ; the longer is folded to the length of the other."""

    def folded(long: str, short: str) -> Column:
        half = F.size(short)
        halves = F.slice(long, F.lit(1), half), F.slice(long, half + 1, half)
        xor = F.zip_with(*halves, lambda i, j: i.bitwiseXOR(j))
        return F.when(F.size(long) > half, xor).otherwise(F.col(long))

    counts = F.zip_with(folded(x, y), folded(y, x), lambda i, j: F.bit_count(i.bitwiseXOR(j)))
    return F.aggregate(counts, F.lit(0), lambda total, i: total + i)


def _alike(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose parity bits allow the similarity; no similar pair is lost.

    Sizes of similar sets differ by less than a factor of two, so one fold is enough.
    """
    for end, other in (("a", "b"), ("b", "a")):
        named = known.select(
            F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("bits").alias(f"{end}_bits")
        )
        pairs = salted_join(pairs, named, [end], [other])
    total = F.col("a_n") + F.col("b_n")
    spare = total - 2 * _least(total, similarity)
    return pairs.where(_differing("a_bits", "b_bits") <= spare).select("a", "b")


def _sets(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """``node`` and its shingles for all nodes of ``pairs``, from the texts once more."""
    places = stored(known.join(_nodes(pairs), "node", "left_semi").select("node", "_hash"), "near-places")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.drop_duplicates("node")
            batch = batch[~batch["node"].isin(seen)]
            seen.update(batch["node"].tolist())
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in batch["_text"]]
            yield pd.DataFrame({"node": batch["node"], "words": pd.Series(sets, index=batch.index, dtype=object)})

    texts = docs.select("_hash", "_text").join(places, "_hash").select("node", "_text")
    found = texts.mapInPandas(cut, "node bigint, words array<bigint>")
    return stored(found.groupBy("node").agg(F.first("words").alias("words")), "near-sets")


def _verified(docs: DataFrame, marked: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` whose sets have the similarity. Nodes of many pairs are dealt over tasks.

    Sets travel only for pairs that differ in few enough parity bits.
    """
    known = marked.join(_nodes(pairs), "node", "left_semi").groupBy("node").agg(
        F.min("_hash").alias("_hash"), F.first("n").alias("n"), F.first("bits").alias("bits")
    )
    known = stored(known, "near-known")
    pairs = stored(_alike(pairs, known, similarity), "near-alike")
    sets = _sets(docs, known, pairs, shingle)
    for end in ("a", "b"):
        busy = pairs.groupBy(end).agg(F.ceil(F.count("*") / 64).cast("int").alias("salts"))
        named = busy.join(sets.withColumnRenamed("node", end), end).select(
            end,
            F.col("words").alias(f"{end}_words"),
            F.explode(F.sequence(F.lit(0), F.least("salts", F.lit(64)) - 1)).alias("salt"),
        )
        salts = salted_join(pairs, busy, [end], ["b" if end == "a" else "a"]).select(
            "*", F.pmod(F.xxhash64("a", "b"), F.least("salts", F.lit(64))).cast("int").alias("salt")
        )
        pairs = salts.drop("salts").join(named, [end, "salt"]).drop("salt")
    both = F.size(F.array_intersect("a_words", "b_words"))
    together = F.size("a_words") + F.size("b_words") - both
    return pairs.where(both >= F.lit(similarity) * together - 1e-9).select("a", "b")


def similar_links(docs: DataFrame, marked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` of similar sets that connect all that such links connect.

    Under a shingle of more than two texts all are compared with the smallest first; pairs
    that those links connect already are not looked at again, all others are. So copies in
    great numbers cost their number, not its square.
    """
    entries = marked.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select(
        "token", F.struct("n", "node", "pos").alias("e")
    )
    # Most shingles stand in one set only: those go before anything else about them moves.
    shared = entries.groupBy("token").agg(F.min("e.node").alias("one"), F.max("e.node").alias("two"))
    shared = stored(shared.where("one <> two").select("token"), "near-shared")
    entries = stored(salted_join(entries, shared, ["token"], ["e.node"]), "near-prefixes")
    tokens = entries.groupBy("token").agg(
        F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("*").alias("count")
    )
    tokens = stored(tokens, "near-tokens")
    many = tokens.where("count > 2").select("token", "lo", "count")
    many_entries = stored(
        salted_join(entries, many, ["token"], ["e.node"]).select("token", "e", "lo", "count").distinct(),
        "near-entries",
    )
    pairs = _pairs(tokens.where("count = 2"), "lo", "hi", similarity)
    stars = _pairs(many_entries, "lo", "e", similarity)
    first = stored(pairs.unionByName(stars).distinct(), "near-pairs")
    links = stored(_verified(docs, marked, first, shingle, similarity), "near-links")
    roots = components(links, "near-first")
    labelled = many_entries.withColumn("node", F.col("e.node")).join(roots, "node", "left").select(
        "token", "e", "lo", F.coalesce("root", "node").alias("root")
    )
    labelled = stored(labelled, "near-labelled")
    sizes = labelled.groupBy("token").agg(
        F.count("*").alias("count"), F.min("root").alias("one"), F.max("root").alias("two")
    )
    sizes = sizes.where("one <> two AND count > 2").select(
        "token", F.ceil(F.col("count") / _CHUNK).cast("int").alias("parts")
    )
    # Part i meets every part j >= i under a key of its own.
    dealt = (
        salted_join(labelled, sizes, ["token"], ["e.node"])
        .where("e.node <> lo.node")
        .withColumn("p", F.pmod(F.xxhash64("e.node"), F.col("parts")).cast("int"))
    )
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.withColumn("j", part).where("j >= p").select(
        "token", F.col("p").alias("i"), "j", F.col("e").alias("x"), F.col("root").alias("x_root")
    )
    right = dealt.withColumn("i", part).where("i <= p").select(
        "token", "i", F.col("p").alias("j"), F.col("e").alias("y"), F.col("root").alias("y_root")
    )
    rest = left.join(right, ["token", "i", "j"]).where("x_root <> y_root")
    rest = stored(_pairs(rest, "x", "y", similarity).join(first, ["a", "b"], "left_anti"), "near-rest")
    if rest.isEmpty():
        return links
    return links.unionByName(_verified(docs, marked, rest, shingle, similarity))


def jaccard_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """``id_column`` and ``component_id`` (smallest id reachable) for every row.

    Two texts are linked if the Jaccard similarity of their sets of shingles is at least
    ``similarity``, and components follow links. The join is exact: prefix, length and
    positional filters only drop pairs that can't be similar, and what is left is verified
    on the sets (64-bit hashes). Texts without words are alike; null counts as empty.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    marked = stored(_marked(narrow, shingle, similarity), "near-marked")
    links = stored(similar_links(narrow, marked, shingle, similarity), "near-all-links")
    labels = components(links, "near-components")
    nodes = marked.groupBy("node").agg(F.min("_id").alias("_least"))
    named = nodes.join(labels, "node", "left").select("node", "_least", F.coalesce("root", "node").alias("_root"))
    named = stored(named, "near-named")
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    answers = salted_join(named, least, ["_root"], ["node"]).select("node", "component_id")
    return salted_join(marked.select("_id", "node"), answers, ["node"], ["_id"]).select(
        F.col("_id").alias(id_column), "component_id"
    )
