"""Whitening of vectors by shifted CholeskyQR: Gram passes over the rows, small factors on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import stored

# Entries of greater size count as this large, so that sums of a batch stay exact.
LARGEST = 1 << 40
_UNIT = 2.0**-53
# Rows that one partial Gram matrix adds up; bounds its rounding error.
_SUMMED = 10_000
_MOST_PASSES = 6


@dataclass(frozen=True)
class Centre:
    """How many vectors there are, and their exact sums."""

    n: int
    sums: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.sums)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: 64-bit numbers, or Python's where those are too short."""
        largest = max(abs(s) for s in self.sums) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if largest < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` with one rounding, as the numerator is exact."""
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S) ** 2``; None where 64 bits don't hold one."""
        scaled = self.scaled(x)
        if scaled.dtype == object or float(np.abs(scaled).max(initial=0)) ** 2 * self.width >= 2.0**62:
            found = (sum(int(v) ** 2 for v in row) for row in scaled)
            return [d if d < 1 << 63 else None for d in found]
        return (scaled * scaled).sum(axis=1).tolist()


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors of the covariance as columns, their eigenvalues, and its trace."""

    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.eigenvalues)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def solve_right(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangle, by substitution column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def on_grid(vector: str, grid: int, offset: int) -> Column:
    """Entries as exact integers: ``floor(grid * entry) + offset``."""

    def number(entry: Column) -> Column:
        value = F.greatest(F.least(entry.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
        return (F.floor(value * grid) + offset).cast("bigint")

    return F.transform(vector, number)


def usable(vector: str, width: int) -> Column:
    """Whether a vector has the width and only finite entries."""
    infinite = F.lit(float("inf"))
    fine = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < infinite)
    )
    return F.coalesce((F.size(vector) == width) & fine, F.lit(False))


def _summed(parts: DataFrame, value: Column) -> dict[int, object]:
    """Totals per cell; there are at most width * width of them."""
    return {r["cell"]: r["total"] for r in parts.groupBy("cell").agg(F.sum(value).alias("total")).collect()}


def centre_of(rows: DataFrame, width: int) -> Centre:
    """Count and sums of the integer vectors in ``_x``."""
    cells = np.arange(width + 1, dtype=np.int32)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            # Sums of 4,096 rows are exact; more rows give more parts.
            for at in range(0, len(x), 4096):
                total = [len(x[at : at + 4096]), *x[at : at + 4096].sum(axis=0).tolist()]
                yield pa.RecordBatch.from_pydict({"cell": cells, "part": total})

    parts = rows.select("_x").mapInArrow(sums, "cell int, part bigint")
    total = _summed(parts, F.col("part").cast("decimal(38,0)"))
    return Centre(int(total.get(0, 0)), tuple(int(total.get(1 + i, 0)) for i in range(width)))


def gram(rows: DataFrame, width: int, project: Callable[[np.ndarray], np.ndarray], out: int) -> np.ndarray:
    """The sum of ``q' q`` over all projected rows ``q`` of ``out`` numbers, in one pass."""
    upper = np.triu_indices(out)
    cells = (upper[0] * out + upper[1]).astype(np.int32)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((out, out)), False
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            for at in range(0, len(x), _SUMMED):
                q = project(x[at : at + _SUMMED])
                total += q.T @ q
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"cell": cells, "part": total[upper]})

    found = _summed(rows.select("_x").mapInArrow(partial, "cell int, part double"), F.col("part"))
    whole = np.zeros((out, out))
    for cell, value in found.items():
        whole[cell // out, cell % out] = whole[cell % out, cell // out] = value
    return whole


def _shifted(matrix: np.ndarray) -> np.ndarray:
    """The upper Cholesky factor after a shift that covers the rounding of the Gram pass."""
    width = len(matrix)
    shift = 11 * (_SUMMED * width + width * (width + 1)) * _UNIT * np.trace(matrix)
    return np.linalg.cholesky(matrix + shift * np.eye(width)).T


def triangular_factors(rows: DataFrame, centre: Centre) -> list[np.ndarray]:
    """Factors whose product ``R`` (the last one leftmost) has ``R' R`` = centred rows' Gram.

    The first pass shifts its Gram matrix, so that it has a Cholesky factor however
    dependent the columns are. Every pass orthogonalises the rows by triangular solves with
    all factors so far and takes the factor of what is left. Once the rows are nearly
    orthonormal, the next factor is the last. Columns that depend on one another stay short
    of that; after six passes the last factor is the symmetric root, which always exists.
    """
    factors: list[np.ndarray] = []
    for step in range(_MOST_PASSES):

        def orthogonal(x: np.ndarray, solved=tuple(factors)) -> np.ndarray:
            q = centre.centred(x)
            for upper in solved:
                q = solve_right(q, upper)
            return q

        left = gram(rows, centre.width, orthogonal, centre.width)
        if step == 0:
            if not left.any():
                return [left]
            factors.append(_shifted(left))
            continue
        if step == _MOST_PASSES - 1:
            values, vectors = np.linalg.eigh(left)
            return [*factors, (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T]
        try:
            factors.append(np.linalg.cholesky(left).T)
            if np.abs(left - np.eye(centre.width)).max() < 1e-4:
                return factors
        except np.linalg.LinAlgError:
            factors.append(_shifted(left))
    raise AssertionError("the last pass returns")


def components_of(factors: list[np.ndarray], n: int, most: int) -> Components:
    """The leading components, from the singular values of the composed factor."""
    composed = factors[0]
    for upper in factors[1:]:
        composed = upper @ composed
    _, singular, transposed = np.linalg.svd(composed)
    # What rounding makes of an eigenvalue of zero isn't a component.
    real = singular > len(singular) * 2.0**-40 * singular[0] if len(singular) else singular > 0
    many = min(most, int(real.sum()))
    values = singular[:many] ** 2 / n
    return Components(transposed[:many].T, values, float((singular**2).sum() / n))


def whiten(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = 32,
    grid: int = 64,
    offset: int = 1_000_000,
) -> DataFrame:
    """Whitened coordinates of every vector; one row per vector and component.

    Entries lie on a grid: ``x = floor(grid * entry) + offset``, so that sums are exact
    integers however the rows are dealt out. Columns: the id, ``component`` (from 1, by
    falling eigenvalue of the covariance of ``x``, divisor n), ``n``, ``deviation`` (the sum
    of ``(n * x - S) ** 2`` over the entries; null where 64 bits don't hold it), ``whitened``,
    ``explained`` (eigenvalue over trace) and ``identity_error`` (the largest entry by size of
    the whitened rows' covariance minus the identity). A component's sign is either, the same
    in all rows.

    Six to nine narrow passes over the vectors; the driver holds a few matrices of width by
    width, no rows. Left out are vectors that are null, that hold null or non-finite entries,
    and, of vectors of several widths, all but the most common one (of equally common ones
    the smallest). Entries beyond ``LARGEST`` count as that large. Components whose eigenvalue
    is zero to rounding are left out: with one vector, or all equal, no row comes back. Null
    ids and repeated rows are vectors like others; other columns are left out.
    """
    vectors = df.select(F.col(id_column).alias("_id"), F.col(vector_column).alias("_vector"))
    kind = vectors.schema["_id"].dataType
    wide = vectors.where("size(_vector) > 0").groupBy(F.size("_vector").alias("width")).count()
    most = wide.orderBy(F.desc("count"), "width").first()
    schema = T.StructType([
        T.StructField(id_column, kind),
        *(
            T.StructField(name, of)
            for name, of in [
                ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
                ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()),
            ]
        ),
    ])
    nothing = df.sparkSession.createDataFrame([], schema)
    if most is None:
        return nothing
    width = most["width"]
    exact = on_grid("_vector", grid, offset).alias("_x")
    rows = stored(vectors.where(usable("_vector", width)).select("_id", exact), "whitening")
    centre = centre_of(rows, width)
    if centre.n == 0:
        return nothing
    found = components_of(triangular_factors(rows, centre), centre.n, components)
    weights = found.weights
    many = weights.shape[1]
    if many == 0:
        return nothing

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.hstack([centre.centred(x) @ weights, np.ones((len(x), 1))])

    products = gram(rows, width, with_one, many + 1) / centre.n
    means = products[:-1, -1]
    covariance = products[:-1, :-1] - np.outer(means, means)
    error = float(np.abs(covariance - np.eye(many)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            values = (centre.centred(x) @ weights).ravel()
            ends = np.arange(0, len(values) + 1, many, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(centre.deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                ["_id", "deviation", "_values"],
            )

    made = T.StructType([
        T.StructField("_id", kind),
        T.StructField("deviation", T.LongType()),
        T.StructField("_values", T.ArrayType(T.DoubleType())),
    ])
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.eigenvalues])
    return (
        rows.mapInArrow(project, made)
        .select("_id", "deviation", F.posexplode("_values").alias("_place", "whitened"))
        .select(
            F.col("_id").alias(id_column),
            (F.col("_place") + 1).alias("component"),
            F.lit(centre.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained[F.col("_place")].alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
