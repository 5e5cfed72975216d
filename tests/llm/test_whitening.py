"""Whitening against eigenvectors of the whole covariance in one place."""

import math

import numpy as np
import pytest

import __spark_entry__ as driver
from courtside.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, n int, component string, _id int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(parts)


def expected(rows):
    """x, exact deviations, eigenvalues and eigenvectors of the usable rows."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[n * a - s for a, s in zip(row, sums, strict=True)] for row in x], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return deviations, centred, values[::-1], axes[:, ::-1]


def compare(found, rows, many, tolerance=1e-7):
    deviations, centred, values, axes = expected(rows)
    whitened = centred @ axes[:, :many] / np.sqrt(values[:many])
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(rows) * many
    order = [i for i, _ in rows]
    got = np.array([[by_id[i][c + 1].whitened for c in range(many)] for i in order])
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < tolerance
    for i, want in zip(order, deviations, strict=True):
        assert {r.deviation for r in by_id[i].values()} == {want}
        assert {r.n for r in by_id[i].values()} == {len(rows)}
    for c in range(many):
        assert by_id[order[0]][c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert len({r.identity_error for r in found}) == 1
    assert found[0].identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_eigenvectors(spark, parts):
    draw = np.random.default_rng(4)
    mixed = draw.normal(size=(300, 8)) @ draw.normal(size=(8, 8))
    rows = list(enumerate(mixed.tolist()))
    compare(whitening.whiten(vectors(spark, rows, parts), components=5).collect(), rows, 5)
    compare(whitening.whiten(vectors(spark, rows, parts), components=32).collect(), rows, 8)


def test_nearly_dependent_columns_stay_orthogonal(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(400, 4)) * [1e6, 1e3, 1, 1]
    base[:, 3] = base[:, 0] + base[:, 3] / 8
    rows = list(enumerate(base.tolist()))
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert len(found) == 1600
    assert found[0].identity_error < 1e-6
    whitened = np.zeros((400, 4))
    for r in found:
        whitened[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(whitened.T @ whitened / 400 - np.eye(4)).max() < 1e-6


def test_dependent_and_constant_columns_give_fewer_components(spark):
    draw = np.random.default_rng(6)
    a = draw.integers(-50, 50, size=(200, 3)).astype(float)
    rows = list(enumerate(np.column_stack([a, a[:, 0] + a[:, 1], np.full(200, 7.0), a[:, 2]]).tolist()))
    compare(whitening.whiten(vectors(spark, rows)).collect(), rows, 3)


def test_unusable_vectors_are_left_out(spark):
    draw = np.random.default_rng(7)
    good = [(i, v) for i, v in enumerate(draw.normal(size=(60, 3)).tolist())]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 1.0]), (105, [1.0, 2.0])]
    compare(whitening.whiten(vectors(spark, bad + good)).collect(), good, 3)


def test_repeated_rows_null_ids_and_large_entries(spark):
    rows = [(None, [1.0, 2.0]), (1, [3.0, -4.0]), (1, [3.0, -4.0]), (2, [1e300, 5.0]), (3, [-1e300, 0.0])]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert len(found) == 10 and {r.n for r in found} == {5}
    assert all(math.isfinite(r.whitened) for r in found)
    # Far-off entries make deviations that 64 bits don't hold.
    assert {r.deviation for r in found if r.vec_id in (2, 3)} == {None}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_without_variance_there_are_no_rows(spark, rows):
    found = whitening.whiten(vectors(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 0


def test_other_id_types_and_names(spark):
    rows = [("a", [1.0, 2.0]), ("b", [2.0, 2.5]), (None, [0.0, 9.0])]
    df = spark.createDataFrame(rows, "whitened string, n array<double>")
    found = whitening.whiten(df, "whitened", "n").toDF("id", "component", "n", "d", "w", "e", "i")
    assert found.count() == 6 and dict(found.dtypes)["id"] == "string"


def test_deviations_beyond_64_bits():
    centre = whitening.Centre(3, (1 << 61, 0))
    found = centre.deviations(np.array([[1 << 60, 5], [(1 << 61) // 3, 7]], dtype=np.int64))
    assert found == [None, sum(v * v for v in (3 * ((1 << 61) // 3) - (1 << 61), 21))]


def test_triangular_solve():
    draw = np.random.default_rng(8)
    upper = np.triu(draw.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = draw.normal(size=(10, 6))
    assert np.allclose(whitening.solve_right(rows, upper) @ upper, rows)


def test_query_on_the_whole_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    usable = [
        (r.vec_id, r.embedding) for r in table
        if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)
    ]
    found = driver.queries()["op13_embedding_whitening"](spark, folder).collect()
    compare(found, usable, 32, 1e-6)
