"""Line dedup: an exact set-similarity join of lines that removes later matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored

# Word counts are kept in this many hashed buckets: they only order tokens, so that two
# words in a bucket cost time and never a match.
_BUCKET_BITS = 22
# Buckets are summed in as many ranges.
_RANGES = 256
# Bits of the filter that tells which lines' words are wanted, at least and at most; a wrong
# yes is joined away.
_FILTER_BITS = 23, 28
# Text bytes whose prefix entries share a slot, about: the unit of the join's Python side.
_SLOT_BYTES = 16 << 20
# Groups larger than this are compared block by block.
_LARGE = 1024
_BLOCK = 512
_SEEN = 200_000
# Bytes of the texts that are cut into words together.
_SLICE = 1 << 19
# Bytes whose sums are taken together.
_STRIDE = 1 << 16

_LINE = (
    "doc bigint, hash bigint, line int, raw bigint, key bigint, check bigint, n int, "
    "skip int, prefix array<int>, bits array<bigint>"
)
# A prefix entry, packed: many share a row on their way to the slot of their token.
_ENTRY = np.dtype([("token", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("key", "<i8")])


def _hashes(texts: list[str]) -> np.ndarray:
    """XXH64 with the seed that Spark's function of that name uses."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t.encode("utf-8", "replace"), 42) for t in texts), np.uint64, len(texts))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


# What ``str.split`` cuts at, in ASCII and beyond.
_ASCII_SPACES = [*range(9, 14), *range(28, 33)]
_OTHER_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANKED = bytes(32 if i in _ASCII_SPACES else i for i in range(256))
# A word's hash is the sum of its bytes' values times powers of an odd number, mixed.
_VALUES = _mix(np.arange(1, 257, dtype=np.uint64), 0x2545F4914F6CDD1D)
_VALUES[_ASCII_SPACES] = 0
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _cached_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STRIDE)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of the base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[:1] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def _plain(text: str) -> str:
    lower = text.lower()
    return lower if lower.isascii() else _OTHER_SPACES.sub(" ", lower)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + lengths[i]`` for all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each line of the ``texts`` has, and the hashes of all words in order.

    The words of a line are those of ``line.lower().split()``.
    """
    body = "\n".join(map(_plain, texts)).encode("utf-8", "replace")
    data = np.frombuffer(body, np.uint8)
    space = np.ones(len(data) + 2, dtype=bool)
    np.equal(np.frombuffer(body.translate(_BLANKED), np.uint8), 32, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    lines = np.append(np.flatnonzero(data == 10), len(data)) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, lines), prepend=0)
    hashed = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + _STRIDE, "right")))
        size = int(ends[last - 1] - begin)
        powers, inverses = _cached_powers() if size <= _STRIDE else _powers(size)
        terms = np.take(_VALUES, data[begin : begin + size], mode="clip")
        terms *= powers[:size]
        totals = np.cumsum(terms, out=terms)
        i, j = starts[first:last] - begin, ends[first:last] - begin
        # The sum up to a blank is the sum up to the word before it.
        before = totals[i - 1]
        before[:1] = 0
        hashed[first:last] = _mix((totals[j - 1] - before) * inverses[i], 0)
        first = last
    return counts, hashed


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, about as many at once as make a slice of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // _SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(begin, end - begin)
            # Workers live on after a task; what a slice took goes back at once.
            pa.default_memory_pool().release_unused()


def required(total: np.ndarray, similarity: float) -> np.ndarray:
    """Least overlap of two sets of ``total`` tokens together that have the similarity."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)


def _word_ranks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often words of each bucket occur in all texts, as a rank, and the texts' bytes.

    Ranks are steps of an eighth of an octave, and 0 where a bucket has one occurrence at
    most. A task counts to 255 in each bucket: ranks only order tokens, and any order serves
    as long as it is one for all lines.
    """
    width = (1 << _BUCKET_BITS) // _RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _BUCKET_BITS, dtype=np.uint32)
        size = 0
        for batch in _slices(batches):
            _, hashed = _words(batch.column("_text").to_pylist())
            buckets = np.sort((hashed >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32))
            begins = np.flatnonzero(np.diff(buckets, prepend=-1))
            counts[buckets[begins]] += np.diff(begins, append=len(buckets)).astype(np.uint32)
            size += pc.sum(pc.binary_length(batch.column("_text"))).as_py() or 0
        body = np.minimum(counts, 255).astype(np.uint8).reshape(_RANGES, width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(_RANGES, dtype=np.int32)),
                pa.array([row.tobytes() for row in body], pa.binary()),
                pa.array(np.where(np.arange(_RANGES) == 0, size, 0)),
            ],
            names=["part", "body", "size"],
        )

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for body in frame["body"]:
            total += np.frombuffer(body, dtype=np.uint8)
        ranks = np.where(total > 1, np.minimum(255, 8 * np.log2(np.maximum(total, 1))), 0)
        row = (frame["part"].iloc[0], ranks.astype(np.uint8).tobytes(), frame["size"].sum())
        return pd.DataFrame([row], columns=["part", "body", "size"])

    schema = "part int, body binary, size bigint"
    found = docs.select("_text").mapInArrow(count, schema).groupBy("part").applyInPandas(ranked, schema)
    ranks = np.zeros((_RANGES, width), dtype=np.uint8)
    size = 0
    for batch in found.toArrow().to_batches():
        for part, body, bytes_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ranks[part] = np.frombuffer(body, dtype=np.uint8)
            size += bytes_
    return ranks.ravel(), size


def _sorted_sets(counts: np.ndarray, tokens: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tokens of each line by rank, then hash; their ranks; the sizes of the sets.

    ``counts`` are the tokens each line has, at least one.
    """
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    packed = (line << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(36)) | (tokens >> np.uint64(28))
    order = np.argsort(packed)
    inside = packed[order]
    mixed = (inside[1:] == inside[:-1]) & (tokens[order[1:]] != tokens[order[:-1]])
    if len(counts) >> 20 or mixed.any():
        order = np.lexsort((tokens, rank, line))
    tokens, line = tokens[order], line[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
    sizes = np.bincount(line[new].astype(np.int64), minlength=len(counts))
    return tokens[new], rank[order][new], sizes


def _widths(n: np.ndarray) -> np.ndarray:
    """How many 64-bit words hold the parity bits of sets of ``n`` tokens: a power of two."""
    words = np.maximum(1, (n + 63) // 64)
    return 1 << np.ceil(np.log2(words) - 1e-12).astype(np.int64)


def _parities(tokens: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """For each bit place of each set, whether an odd number of its tokens falls on it."""
    begins = 64 * (np.cumsum(widths) - widths)
    places = (tokens & np.repeat((64 * widths - 1).astype(np.uint64), sizes)).astype(np.int64)
    odd = np.bincount(places + np.repeat(begins, sizes), minlength=64 * int(widths.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _line_table(docs: DataFrame, ranks: np.ndarray, similarity: float) -> DataFrame:
    """A row per line with words: its place, its set's key and size, its prefix tokens.

    Tokens are ordered by rank, rarest first (ties by hash); the prefix is as long as two
    similar sets need to share a token in it, less its first ``skip`` tokens, which occur
    nowhere else. ``bits`` holds the parity of tokens per bit place, with as many places as
    tokens or more: the number of bits in which two lines differ never exceeds that of tokens
    only one of them has. Prefix and bits are left empty where the task had the same set before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        seen: set[int] = set()
        for batch in _slices(batches):
            texts = batch.column("_text").to_pylist()
            counts, tokens = _words(texts)
            used = np.flatnonzero(counts)
            if not len(used):
                continue
            cut = [text.split("\n") for text in texts]
            each = np.array([len(x) for x in cut])
            owners = np.repeat(np.arange(len(cut)), each)[used]
            places = _ragged(np.zeros(len(cut), dtype=np.int64), each)[used]
            raw = _hashes([x for text in cut for x in text])[used]
            rank = ranks[(tokens >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)]
            tokens, rank, n = _sorted_sets(counts[used], tokens, rank)
            starts = np.cumsum(n) - n
            key = np.add.reduceat(_mix(tokens, 0x5851F42D4C957F2D), starts)
            check = np.add.reduceat(_mix(tokens, 0x14057B7EF767814F), starts)
            skip = np.add.reduceat((rank == 0).astype(np.int64), starts)
            long = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            skip = np.minimum(skip, long)
            fresh = np.zeros(len(n), dtype=bool)
            for i, k in enumerate(key.tolist()):
                if k not in seen:
                    fresh[i] = True
                    seen.add(k)
            if len(seen) > _SEEN:
                seen.clear()
            long = np.where(fresh, long - skip, 0)
            prefix = (tokens[_ragged(starts + skip, long)] >> np.uint64(20)).astype(np.uint32).view(np.int32)
            asked = np.where(long > 0, n, 0)
            widths = np.where(long > 0, _widths(n), 0)
            bits = _parities(tokens[_ragged(starts, asked)], asked, widths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(owners)),
                    batch.column("_hash").take(pa.array(owners)),
                    pa.array(places.astype(np.int32)),
                    _signed(raw),
                    _signed(key),
                    _signed(check),
                    pa.array(n.astype(np.int32)),
                    pa.array(skip.astype(np.int32)),
                    _lists(long, pa.array(prefix)),
                    _lists(widths, _signed(bits)),
                ],
                names=[part.split()[0] for part in _LINE.split(", ")],
            )

    return docs.select("_id", "_hash", "_text").mapInArrow(tabulate, _LINE)


def _passes(rows: dict, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Length, positional and bit filter for pairs of rows of one token.

    ``bits`` are all parities folded into 64; ``wide``, if given, the whole ones, ``width``
    words from ``at`` for each row.
    """
    n = rows["n"]
    total = n[i] + n[j]
    least = required(total, similarity)
    spare = total - 2 * least
    ok = np.bitwise_count(rows["bits"][i] ^ rows["bits"][j]) <= spare
    if "wide" not in rows:
        return ok & _long_enough(rows, i, j, least, similarity)
    left = np.flatnonzero(ok)
    i, j, spare = i[left], j[left], spare[left]
    fits = _long_enough(rows, i, j, least[left], similarity)
    ok[left] = fits
    left, i, j, spare = left[fits], i[fits], j[fits], spare[fits]
    ok[left] = _differing(rows, i, j, spare) <= spare
    return ok


def _long_enough(rows: dict, i: np.ndarray, j: np.ndarray, least: np.ndarray, similarity: float) -> np.ndarray:
    n, left = rows["n"], rows["n"] - rows["pos"]
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (small >= similarity * large - 1e-9) & (np.minimum(left[i], left[j]) >= least)


def _differing(rows: dict, i: np.ndarray, j: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """In how many bits pairs differ, counted until there are more than ``spare``.

    The wider of two is folded to the width of the other.
    """
    width = np.minimum(rows["width"][i], rows["width"][j])
    differing = np.zeros(len(i), dtype=np.int64)
    going = np.arange(len(i))
    at = 0
    while len(going):
        differing[going] += np.bitwise_count(
            _folded(rows, i[going], width[going], at) ^ _folded(rows, j[going], width[going], at)
        )
        at += 1
        going = going[(width[going] > at) & (differing[going] <= spare[going])]
    return differing


def _folded(rows: dict, i: np.ndarray, width: np.ndarray, at: int) -> np.ndarray:
    """Word ``at`` of the parities of rows ``i``, folded to ``width`` words."""
    value = rows["wide"][rows["at"][i] + at]
    fold = 1
    while len(more := np.flatnonzero(rows["width"][i] > fold * width)):
        value[more] ^= rows["wide"][rows["at"][i[more]] + fold * width[more] + at]
        fold += 1
    return value


def _partnered(rows: dict, similarity: float) -> np.ndarray:
    """Which rows (distinct) have a partner under their token that passes the filters.

    Rows are compared in the order of their sizes, with those at most so much larger that
    the two can be similar.
    """
    order = np.argsort((rows["token"] << 31) + rows["n"])
    rows = {name: column if name == "wide" else column[order] for name, column in rows.items()}
    token, n = rows["token"], rows["n"]
    size = len(token)
    found = np.zeros(size, dtype=bool)
    begins = np.flatnonzero(np.diff(token, prepend=token[0] - 1)) if size else np.zeros(0, int)
    lengths = np.diff(np.append(begins, size))
    largest = np.minimum(np.floor((n + 1e-9) / similarity).astype(np.int64), (1 << 31) - 1)
    ends = np.searchsorted((token << 31) + n, (token << 31) + largest, "right")
    here = np.flatnonzero(np.repeat(lengths, lengths) <= _LARGE)
    step = 0
    while len(here):
        step += 1
        here = here[here + step < ends[here]]
        asked = here[~(found[here] & found[here + step])]
        ok = _passes(rows, asked, asked + step, similarity)
        found[asked[ok]] = True
        found[asked[ok] + step] = True
    for begin, length in zip(begins[lengths > _LARGE], lengths[lengths > _LARGE], strict=True):
        group = np.arange(begin, begin + length)
        for first in range(0, length, _BLOCK):
            for second in range(0, first + 1, _BLOCK):
                one, two = group[first : first + _BLOCK], group[second : second + _BLOCK]
                if ends[two[-1]] <= one[0] or found[one].all() and found[two].all():
                    continue
                i, j = np.repeat(one, len(two)), np.tile(two, len(one))
                ok = _passes(rows, i, j, similarity) & (i != j)
                found[i[ok]] = True
                found[j[ok]] = True
    back = np.empty(size, dtype=bool)
    back[order] = found
    return back


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by token, cut so that no token is in two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        last = batch["token"] == batch["token"].iloc[-1]
        if last.all():
            held.append(batch)
            continue
        yield pd.concat([*held, batch[~last]])
        held = [batch[last]]
    if held:
        yield pd.concat(held)


def _arrays(frame: pd.DataFrame) -> dict:
    names = ("token", "n", "pos")
    rows = {name: frame[name].to_numpy().astype(np.int64) for name in names}
    wide = np.concatenate([*frame["bits"], np.zeros(0, dtype=np.int64)]).astype(np.int64).view(np.uint64)
    return rows | {"key": frame["key"].to_numpy()} | _spread_bits(rows["n"], wide)


def _spread_bits(n: np.ndarray, wide: np.ndarray) -> dict:
    """The columns for the parities of sets of ``n`` tokens, which follow one another."""
    width = _widths(n)
    at = np.cumsum(width) - width
    bits = np.bitwise_xor.reduceat(wide, at) if len(at) else wide
    return {"wide": wide, "at": at, "width": width, "bits": bits}


def _by_token(df: DataFrame) -> DataFrame:
    return df.repartition("token").sortWithinPartitions("token")


def _survivors(lines: DataFrame, similarity: float, slots: int) -> DataFrame:
    """Prefix entries with a possible partner of another set under the same token.

    Entries travel packed, one row for each slot of tokens and batch of lines. There are
    as many ``slots`` as the texts are large, so a slot holds about the same at any size.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            ends = prefix.offsets.to_numpy()
            each = np.diff(ends)
            rows = np.empty(int(each.sum()), dtype=_ENTRY)
            if not len(rows):
                continue
            line = np.repeat(np.arange(len(each)), each)
            rows["token"] = prefix.flatten().to_numpy().view(np.uint32)
            skip = batch.column("skip").to_numpy()
            rows["pos"] = np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0] - skip, each)
            for name in ("n", "key"):
                rows[name] = batch.column(name).to_numpy()[line]
            slot = (rows["token"].astype(np.uint64) * np.uint64(slots)) >> np.uint64(32)
            order = np.argsort(slot, kind="stable")
            rows, slot, line = rows[order], slot[order], line[order]
            begins = np.flatnonzero(np.diff(slot.astype(np.int64), prepend=-1))
            places = batch.column("bits").offsets.to_numpy()
            wide = batch.column("bits").flatten().to_numpy()
            widths = np.diff(places)[line]
            wide = wide[_ragged(places[line] - places[0], widths)]
            cuts = (np.cumsum(widths) - widths)[begins].tolist()
            pieces = list(zip(begins, [*begins[1:], len(rows)], cuts, [*cuts[1:], len(wide)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slot[begins].astype(np.int32)),
                    pa.array([rows[i:j].tobytes() for i, j, _, _ in pieces], pa.binary()),
                    pa.array([wide[i:j].tobytes() for _, _, i, j in pieces], pa.binary()),
                ],
                names=["slot", "entries", "bits"],
            )

    def filtered(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, dtype=_ENTRY) for x in frame["entries"]])
        wide = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in frame["bits"]])
        spread = _spread_bits(rows["n"].astype(np.int64), wide)
        keys = np.ascontiguousarray(rows["key"]).view(np.uint64)
        packed = (rows["token"].astype(np.uint64) << np.uint64(32)) | (keys >> np.uint64(32))
        order = np.argsort(packed)
        packed, key = packed[order], rows["key"][order]
        if ((packed[1:] == packed[:-1]) & (key[1:] != key[:-1])).any():
            order = np.lexsort((rows["key"], rows["token"]))
            key = rows["key"][order]
        token = rows["token"][order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
        # Only rows with a neighbour under their token can have a partner.
        token, order = token[new], order[new]
        same = np.concatenate([[False], token[1:] == token[:-1], [False]])
        order = order[same[1:] | same[:-1]]
        rows = rows[order]
        columns = {name: rows[name].astype(np.int64) for name in ("token", "n", "pos")}
        columns |= {name: spread[name][order] for name in ("at", "width", "bits")} | {"wide": wide}
        found = np.flatnonzero(_partnered(columns, similarity))
        left, widths = rows[found], columns["width"][found]
        bits = wide[_ragged(columns["at"][found], widths)].view(np.int64)
        return pd.DataFrame(
            {
                "token": left["token"].astype(np.int64),
                "key": left["key"],
                "n": left["n"].astype(np.int32),
                "pos": left["pos"].astype(np.int32),
                "bits": pd.Series(np.split(bits, np.cumsum(widths)[:-1]) if len(left) else [], dtype=object),
            }
        )

    return (
        lines.where(F.size("prefix") > 0)
        .select("key", "n", "skip", "prefix", "bits")
        .mapInArrow(packed, "slot int, entries binary, bits binary")
        .groupBy("slot")
        .applyInPandas(filtered, "token bigint, key bigint, n int, pos int, bits array<bigint>")
    )


def _candidates(entries: DataFrame, low: int, high: int, similarity: float) -> DataFrame:
    """Earlier partners number ``low`` to ``high`` - 1 of every open entry, under each token."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches):
            frame = frame.sort_values(["token", "doc", "hash", "line"], na_position="first")
            rows = _arrays(frame)
            is_open = frame["open"].to_numpy().astype(bool)
            begins = np.flatnonzero(np.diff(rows["token"], prepend=rows["token"][0] - 1))
            starts = np.repeat(begins, np.diff(np.append(begins, len(frame))))
            asked = np.flatnonzero(is_open)
            taken = np.zeros(len(frame), dtype=np.int64)
            step = 0
            while len(asked):
                j = starts[asked] + step
                alive = (j < asked) & (taken[asked] < high)
                asked, j = asked[alive], j[alive]
                ok = _passes(rows, asked, j, similarity)
                wanted = ok & (taken[asked] >= low)
                taken[asked[ok]] += 1
                if wanted.any():
                    yield pd.DataFrame(
                        {"key": rows["key"][asked[wanted]], "other": rows["key"][j[wanted]]}
                    )
                step += 1

    return _by_token(entries).mapInPandas(pairs, "key bigint, other bigint").distinct()


def _word_sets(docs: DataFrame, wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``key`` and its sorted word hashes for the ``wanted`` keys.

    A third pass over the texts: lines whose raw hash is in a bit filter of fixed size
    are cut into words, the others are passed over; a join then leaves what was asked for.
    """
    places = lines.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("raw").alias("raw"))
    places = stored(places, "line-places")
    least, most = _FILTER_BITS
    places_bits = min(most, max(least, (16 * places.count()).bit_length()))
    shift = 64 - places_bits
    slot = F.shiftrightunsigned("raw", shift)
    words = places.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(raw, {shift}) & 63 as int))")).alias("v")
    )
    bits = np.zeros(1 << (places_bits - 6), dtype=np.uint64)
    for batch in words.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in _slices(batches):
            lines = [x for text in batch.column("_text").to_pylist() for x in text.split("\n")]
            hashed = _hashes(lines)
            at = hashed >> np.uint64(shift)
            hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            found = []
            for i in np.flatnonzero(hit).tolist():
                if (raw := int(hashed[i])) not in seen:
                    seen.add(raw)
                    found.append(i)
            if len(seen) > _SEEN:
                seen.clear()
            counts, tokens = _words([lines[i] for i in found])
            # A wrong yes may be a line without words.
            raws, counts = hashed[found][counts > 0], counts[counts > 0]
            if len(counts):
                tokens, _, sizes = _sorted_sets(counts, tokens, np.zeros(len(tokens), dtype=np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [_signed(raws), _lists(sizes, _signed(tokens))], names=["raw", "words"]
                )

    cuts = docs.select("_text").mapInArrow(cut, "raw bigint, words array<bigint>")
    # Copies of a line are equal rows; one of them is enough.
    return (
        cuts.join(places, "raw").groupBy("key").agg(F.first("words").alias("words"))
    )


def matched_lines(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All lines of ``docs`` (``_id``, ``_hash``, ``_text``), and what is known of each set.

    The second table has a row per set of words that costs a line: ``key``, ``check``, the
    place of its first line (``doc``, ``hash``, ``line``) and ``near``: whether an earlier
    line of another set is similar to it.
    """
    ranks, size = _word_ranks(docs)
    lines = stored(_line_table(docs, ranks, similarity), "lines")
    place = F.struct("doc", "hash", "line")
    firsts = lines.groupBy("key", "check").agg(F.min(place).alias("at"), F.count("*").alias("copies"))
    firsts = stored(firsts.select("key", "check", "copies", "at.*"), "line-firsts")
    entries = stored(_survivors(lines, similarity, 1 + size // _SLOT_BYTES), "line-entries")
    keys = stored(entries.select("key").distinct(), "line-keys")
    at = firsts.join(keys, "key", "left_semi").groupBy("key").agg(F.min(place).alias("at"))
    entries = stored(entries.join(at.select("key", "at.*"), "key"), "line-candidates")
    sets = stored(_word_sets(docs, keys, lines), "line-words")
    open_keys, near = keys, []
    low, high = 0, 1
    while True:
        asked = entries.join(open_keys.withColumn("open", F.lit(True)), "key", "left").withColumn(
            "open", F.coalesce("open", F.lit(False))
        )
        pairs = stored(_candidates(asked, low, high, similarity), "line-pairs")
        if pairs.isEmpty():
            break
        asked_for = pairs.select(F.explode(F.array("key", "other")).alias("key")).distinct()
        words = sets.join(asked_for, "key", "left_semi")
        other = words.select(F.col("key").alias("other"), F.col("words").alias("other_words"))
        both = F.size(F.array_intersect("words", "other_words"))
        together = F.size("words") + F.size("other_words") - both
        verified = stored(
            pairs.join(words, "key")
            .join(other, "other")
            .select("key", (both >= F.lit(similarity) * together - 1e-9).alias("similar"))
            .groupBy("key")
            .agg(F.max("similar").alias("similar")),
            "line-verified",
        )
        near.append(verified.where("similar").select("key"))
        open_keys = verified.where("NOT similar").select("key")
        if open_keys.isEmpty():
            break
        # Only tokens of open keys are looked at again.
        tokens = entries.join(open_keys, "key", "left_semi").select("token").distinct()
        entries = stored(entries.join(tokens, "token", "left_semi"), "line-candidates")
        low, high = high, 16 * high
    found = near[0] if near else keys.limit(0)
    for more in near[1:]:
        found = found.unionByName(more)
    marked = firsts.join(found.withColumn("near", F.lit(True)), "key", "left").withColumn(
        "near", F.coalesce("near", F.lit(False))
    )
    return lines, marked.where(F.col("near") | (F.col("copies") > 1)).drop("copies")


def dedup_lines(
    docs: DataFrame,
    similarity: float = 0.8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the lines that have an earlier match, with ``n_lines``, ``n_removed``.

    A line is the set of its lower-cased words; it goes if the Jaccard similarity to any
    line before it is at least ``similarity``, whether that line stays or not. Lines are
    ordered by document id (nulls first), then a hash of the text, then their place. Lines
    without words always stay. All columns of ``docs`` are returned, the text rewritten;
    columns called ``n_lines`` or ``n_removed`` are replaced.

    Null texts stay null, with no lines; a text may become empty. Rows of equal id and
    text count as one document and share its result. An empty table gives no rows.

    The join is exact: prefix, length, positional and bit filters only drop pairs that
    can't be similar, and what is left is verified on the sets of words (64-bit hashes),
    each line's earliest candidates first, until it has a match or no candidate left.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_column).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text")
    )
    lines, known = matched_lines(narrow, similarity)
    places = lines.select("key", "check", "doc", "hash", "line")
    first = known.select(
        "key", "check", F.col("doc").alias("_d"), F.col("hash").alias("_h"), F.col("line").alias("_l"), "near"
    )
    later = ~(F.col("doc").eqNullSafe(F.col("_d")) & (F.col("hash") == F.col("_h")) & (F.col("line") == F.col("_l")))
    removed = (
        salted_join(places, first, ["key", "check"], ["doc", "hash", "line"])
        .where(later | F.col("near"))
        .groupBy("doc", "hash")
        .agg(F.collect_set("line").alias("_removed"))
        .withColumn("_nothing", F.col("doc").isNull())
        .select(F.coalesce("doc", F.lit(0)).alias("_k"), "_nothing", F.col("hash").alias("_h"), "_removed")
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        kept = []
        for text, gone in zip(texts, removed, strict=True):
            if text is not None and gone is not None and len(gone):
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            kept.append(text)
        return pd.Series(kept, dtype=object)

    key = F.col(id_column).cast("long")
    joined = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != text_column]).alias("_whole"),
        F.col(text_column).cast("string").alias("_text"),
        F.coalesce(key, F.lit(0)).alias("_k"),
        key.isNull().alias("_nothing"),
        F.xxhash64(text).alias("_h"),
    ).join(removed, ["_k", "_nothing", "_h"], "left")
    count = F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1
    return joined.select(
        *[
            without("_text", "_removed").alias(c) if c == text_column else F.col(f"_whole.`{c}`")
            for c in columns
        ],
        F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long").alias("n_removed"),
    )
