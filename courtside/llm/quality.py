"""A quality classifier: a factorisation machine over words, structure and metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURE = (
    "log_chars log_words mean_word long_words distinct_words letters digits upper symbols "
    "blanks stops commas symbol_ends upper_words lines short_lines repeated_lines "
    "common_word common_pair separators empty"
).split()
METADATA = ("log_n_chars", "n_chars_missing")
# Documents whose features are computed together.
_SLICE = 512


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short slices: a batch's texts and features are never all Python objects at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, _SLICE):
            yield batch.slice(begin, _SLICE)
        # Workers live on after a task; what a batch took goes back at once.
        pa.default_memory_pool().release_unused()


class Features:
    """Sparse features of whole texts: hashed words, then structure, then metadata."""

    _buckets: dict[str, int] = {}

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.width = buckets + len(STRUCTURE) + len(METADATA)

    def _bucket(self, word: str) -> int:
        known = Features._buckets
        found = known.get(word)
        if found is None:
            if len(known) >= 100_000:
                known.clear()
            found = known[word] = zlib.crc32(word.encode("utf-8", "replace")) % self.buckets
        return found

    def of(self, text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(text.lower().split())
        bucket = self._bucket
        ids = np.fromiter((bucket(w) for w in counts), dtype=np.int64, count=len(counts))
        values = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        norm = np.sqrt((values * values).sum())
        structure = self._structure(text, words, counts)
        missing = n_chars is None or not np.isfinite(n_chars) or n_chars < 0
        extra = [*structure, 0.0 if missing else np.log1p(n_chars) / 10, float(missing)]
        ids = np.concatenate([ids, np.arange(self.buckets, self.width)])
        return ids, np.concatenate([values / norm if norm else values, extra])

    @staticmethod
    def _structure(text: str, words: list[str], counts: Counter) -> list[float]:
        chars, n = max(1, len(text)), max(1, len(words))
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        low = np.bincount(np.minimum(codes, 128), minlength=129)
        digits, upper = low[48:58].sum(), low[65:91].sum()
        letters = upper + low[97:123].sum() + low[128]
        blanks = low[32] + low[9:14].sum()
        lines = text.split("\n")
        pairs = Counter(zip(words, words[1:], strict=False))
        ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!'\")" for w in words)
        return [
            np.log1p(len(text)) / 10,
            np.log1p(len(words)) / 10,
            len(text) / n / 10,
            sum(len(w) > 20 for w in words) / n,
            len(counts) / n,
            letters / chars,
            digits / chars,
            upper / chars,
            (chars - letters - digits - blanks) / chars,
            blanks / chars,
            10 * low[46] / chars,
            10 * low[44] / chars,
            ends / n,
            sum(w.isupper() and len(w) > 1 for w in words) / n,
            np.log1p(len(lines)) / 5,
            sum(len(x) < 20 for x in lines) / len(lines),
            1 - len(set(lines)) / len(lines),
            max(counts.values(), default=0) / n,
            max(pairs.values(), default=0) / n,
            sum(not any(c.isalnum() for c in w) for w in words) / n,
            float(not words),
        ]


@dataclass
class Machine:
    """Weights of a second-order factorisation machine; the score is a probability."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    buckets: int

    def prepare(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Dense columns centred and scaled, as they were in training."""
        dense = ids >= self.buckets
        at = ids[dense] - self.buckets
        values = values.copy()
        values[dense] = np.clip((values[dense] - self.centre[at]) / self.scale[at], -4, 4) / 4
        return values

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Linear time: pairs are half of (sum of v x) squared less the sum of (v x) squared."""
        x = self.prepare(ids, values)
        weighted = self.factors[ids] * x[:, None]
        sums = np.add.reduceat(weighted, starts)
        squares = np.add.reduceat(weighted * weighted, starts)
        single = np.add.reduceat(self.linear[ids] * x, starts)
        return self.bias + single + 0.5 * (sums * sums - squares).sum(axis=1)


def _sigmoid(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def fit_machine(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    buckets: int,
    rank: int = 8,
    epochs: int = 12,
    rate: float = 0.1,
    penalty: float = 1e-5,
    batch: int = 128,
    seed: int = 7,
) -> Machine:
    """Logistic loss, Adagrad, mini-batches. Without both labels: the smoothed label rate."""
    width = buckets + len(STRUCTURE) + len(METADATA)
    draw = np.random.default_rng(seed)
    rate_of_ones = (labels.sum() + 1) / (len(labels) + 2)
    dense = np.array([v[ids >= buckets] for ids, v in rows]).reshape(len(rows), width - buckets)
    model = Machine(
        bias=float(np.log(rate_of_ones / (1 - rate_of_ones))),
        linear=np.zeros(width),
        factors=draw.normal(0, 0.05, (width, rank)),
        centre=dense.mean(axis=0) if len(rows) else np.zeros(width - buckets),
        scale=np.maximum(dense.std(axis=0), 1e-3) if len(rows) else np.ones(width - buckets),
        buckets=buckets,
    )
    if len(np.unique(labels)) < 2:
        model.factors[:] = 0
        return model
    seen = [np.full(1, 1e-2), np.full(width, 1e-2), np.full((width, rank), 1e-2)]
    for epoch in range(epochs):
        order = draw.permutation(len(rows))
        step = rate / (1 + 0.3 * epoch)
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            sizes = np.array([len(rows[i][0]) for i in chosen])
            ids = np.concatenate([rows[i][0] for i in chosen]).astype(np.int64)
            x = model.prepare(ids, np.concatenate([rows[i][1] for i in chosen]).astype(float))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            weighted = model.factors[ids] * x[:, None]
            sums = np.add.reduceat(weighted, starts)
            squares = np.add.reduceat(weighted * weighted, starts)
            single = np.add.reduceat(model.linear[ids] * x, starts)
            margins = model.bias + single + 0.5 * (sums * sums - squares).sum(axis=1)
            error = (_sigmoid(margins) - labels[chosen]) / len(chosen)
            owner = np.repeat(np.arange(len(chosen)), sizes)
            down = error[owner] * x
            used, back = np.unique(ids, return_inverse=True)
            grad = np.bincount(back, down, len(used)) + penalty * model.linear[used]
            pairs = down[:, None] * (sums[owner] - weighted)
            factor_grad = np.stack(
                [np.bincount(back, pairs[:, f], len(used)) for f in range(rank)], axis=1
            )
            factor_grad += penalty * model.factors[used]
            seen[0] += error.sum() ** 2
            seen[1][used] += grad * grad
            seen[2][used] += factor_grad * factor_grad
            model.bias -= float(step * error.sum() / np.sqrt(seen[0][0]))
            model.linear[used] -= step * grad / np.sqrt(seen[1][used])
            model.factors[used] -= step * factor_grad / np.sqrt(seen[2][used])
    return model


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 15,
    max_labelled: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    size_column: str | None = "n_chars",
) -> Machine:
    """Fit on labelled documents; labels 0 and 1, anything else is left out.

    At most ``max_labelled`` labelled ids are used: those with the smallest hash of the id.
    Their sparse features, and nothing else, come to the driver. A repeated document id
    counts once. Null texts count as empty. With no usable labels the score is 0.5.
    """
    wanted = (
        labels.select(
            F.col(id_column).cast("long").alias("_id"), F.col(label_column).cast("int").alias("_y")
        )
        .where("_id IS NOT NULL AND _y IN (0, 1)")
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    size = F.col(size_column).cast("double") if size_column else F.lit(None).cast("double")
    narrow = docs.select(
        F.col(id_column).cast("long").alias("_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"),
        size.alias("_size"),
    )

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for part in _slices(batches):
            texts, sizes = part.column("_text").to_pylist(), part.column("_size").to_pylist()
            found = [features.of(t, s) for t, s in zip(texts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    part.column("_y"),
                    pa.array([ids.astype("<i4").tobytes() for ids, _ in found], pa.binary()),
                    pa.array([values.astype("<f4").tobytes() for _, values in found], pa.binary()),
                ],
                names=["_id", "_y", "ids", "values"],
            )

    # The list of ids is bounded by max_labelled, hence the broadcast.
    rows = (
        narrow.join(F.broadcast(wanted), "_id")
        .mapInArrow(featurise, "_id bigint, _y int, ids binary, values binary")
        .groupBy("_id", "_y")
        .agg(F.min(F.struct("ids", "values")).alias("row"))
        .orderBy("_id")
        .collect()
    )
    sparse = [
        (np.frombuffer(r.row["ids"], "<i4"), np.frombuffer(r.row["values"], "<f4")) for r in rows
    ]
    return fit_machine(sparse, np.array([r["_y"] for r in rows], dtype=float), buckets)


def score_quality(
    docs: DataFrame,
    model: Machine,
    name: str = "score",
    text_column: str = "text",
    size_column: str | None = "n_chars",
) -> DataFrame:
    """All rows and columns of ``docs`` and ``name``, the probability of label 1.

    Every text is read whole; null counts as empty, and empty texts get a score too. A
    column called ``name`` is replaced. Repeated rows get equal scores, an empty table
    gives no rows.
    """
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = shared.value
        features = Features(machine.buckets)
        for texts, sizes in batches:
            parts = []
            for part in _slices([pa.RecordBatch.from_arrays([texts, sizes], names=["text", "size"])]):
                rows = [features.of(t, s) for t, s in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                counts = np.array([len(ids) for ids, _ in rows])
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                ids, values = (np.concatenate(x) for x in zip(*rows, strict=True))
                parts.append(_sigmoid(machine.margins(ids, values, starts)))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    size = F.col(size_column).cast("double") if size_column else F.lit(None).cast("double")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(*kept, score(text, size).alias(name))
