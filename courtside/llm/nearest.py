"""Approximate nearest neighbours: probed lists scanned by adaptive dimension sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import salted_join, stored

# Dimensions scanned between two tests.
_COLUMNS = 16
# Vectors of a list, and queries, that are compared in one task.
_LIST_PART = 8192
_QUERY_PART = 1024
# Candidates scanned before radii are tightened; queries scanned at once.
_CANDIDATES = 1024
_QUERIES = 256
# Rows of the sample that give each query its first radius.
_RADIUS_ROWS = 4096


@dataclass
class Lists:
    """A rotation and the centres of the lists, in the space where inner product is distance.

    A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest length, a query (q, 0): the
    nearest vector is then the one of largest inner product, whatever the lengths.
    """

    centres: np.ndarray
    rotation: np.ndarray
    longest: float
    known: np.ndarray

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the added dimension, rotated."""
        rest = np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(axis=1)))
        return np.concatenate([vectors, rest[:, None]], axis=1) @ self.rotation

    def query(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1) @ self.rotation

    def radii(self, rotated: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
        """Squared distances that ``keep`` known vectors of each query's lists lie within."""
        if len(self.known) < keep:
            return np.full(len(rotated), np.inf)
        squares = (self.known**2).sum(axis=1)
        mine = self.nearest_lists(self.known, 1)[:, 0]
        out = []
        for begin in range(0, len(rotated), _QUERIES):
            part = rotated[begin : begin + _QUERIES]
            far = squares[None, :] - 2 * part @ self.known.T + (part**2).sum(axis=1)[:, None]
            probed = np.zeros((len(part), len(self.centres)), dtype=bool)
            np.put_along_axis(probed, near[begin : begin + _QUERIES].astype(np.int64), True, axis=1)
            far[~probed[:, mine]] = np.inf
            out.append(np.partition(far, keep - 1, axis=1)[:, keep - 1])
        return np.concatenate(out) * (1 + 1e-9) + 1e-9

    def nearest_lists(self, rotated: np.ndarray, count: int) -> np.ndarray:
        distance = (self.centres**2).sum(axis=1)[None, :] - 2 * rotated @ self.centres.T
        count = min(count, len(self.centres))
        if count == len(self.centres):
            return np.argsort(distance, axis=1)
        return np.argpartition(distance, count - 1, axis=1)[:, :count]


def fit_lists(sample: np.ndarray, lists: int, longest: float, rounds: int = 10, seed: int = 11) -> Lists:
    """A random rotation and centres by Lloyd's rounds over ``sample``."""
    draw = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    rotation = np.linalg.qr(draw.normal(size=(size, size)))[0]
    found = Lists(np.zeros((0, size)), rotation, longest, np.zeros((0, size)))
    placed = found.place(sample)
    found.known = found.place(np.unique(sample[:_RADIUS_ROWS], axis=0))
    centres = placed[draw.permutation(len(placed))[:lists]]
    for _ in range(rounds):
        found.centres = centres
        mine = found.nearest_lists(placed, 1)[:, 0]
        sizes = np.bincount(mine, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, placed)
        used = sizes > 0
        centres = centres.copy()
        centres[used] = sums[used] / sizes[used][:, None]
    found.centres = centres
    return found


def _best(query: np.ndarray, value: np.ndarray, keep: int) -> np.ndarray:
    """Places of each query's ``keep`` least values; values equal to the last stay too."""
    order = np.lexsort((value, query))
    query, value = query[order], value[order]
    begins = np.flatnonzero(np.diff(query, prepend=-1))
    sizes = np.diff(np.append(begins, len(query)))
    last = value[begins + np.minimum(sizes, keep) - 1]
    return order[value <= np.repeat(last, sizes)]


def scan(
    queries: np.ndarray,
    radii: np.ndarray,
    columns: list[np.ndarray],
    keep: int,
    confidence: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and candidate that may be among a query's ``keep`` nearest.

    ``columns`` holds the candidates vertically, a block of dimensions each. After each
    block the squared distance so far, scaled to all dimensions, is tested against the
    query's radius: a candidate whose estimate exceeds it by more than the square of
    ``1 + confidence / sqrt(dimensions seen)`` is abandoned. ``radii`` are squared distances
    that ``keep`` candidates are known to lie within; they shrink from block to block of
    candidates.
    """
    size = sum(c.shape[1] for c in columns)
    total = len(columns[0])
    found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    radii = radii.copy()
    for begin in range(0, total, _CANDIDATES):
        q = c = so_far = None
        seen = 0
        for block in columns:
            part = block[begin : begin + _CANDIDATES]
            asked = queries[:, seen : seen + block.shape[1]]
            seen += block.shape[1]
            if q is None:
                cross = asked @ part.T
                cross *= -2
                cross += (asked**2).sum(axis=1)[:, None]
                cross += (part**2).sum(axis=1)[None, :]
                limit = radii * (1 + confidence / np.sqrt(seen)) ** 2 * seen / size
                q, c = np.nonzero(cross <= limit[:, None] + 1e-9)
                so_far = cross[q, c]
                continue
            so_far = so_far + ((asked[q] - part[c]) ** 2).sum(axis=1)
            # At the end the distance is whole; rounding must not decide ties.
            slack = (1 + confidence / np.sqrt(seen)) ** 2 * seen / size if seen < size else 1 + 1e-9
            near = so_far <= radii[q] * slack + 1e-9
            q, c, so_far = q[near], c[near], so_far[near]
        found = tuple(np.concatenate(x) for x in zip(found, (q, c + begin, so_far), strict=True))
        # Rounded, so that equal vectors at the edge stay together.
        left = _best(found[0], np.round(found[2], 9), keep)
        found = tuple(x[left] for x in found)
        count = np.bincount(found[0], minlength=len(queries))
        furthest = np.zeros(len(queries))
        np.maximum.at(furthest, found[0], found[2])
        radii = np.where(count >= keep, np.minimum(radii, furthest), radii)
    return found[0], found[1]


def _valid(column: str) -> Column:
    values = F.col(column)
    finite = F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return values.isNotNull() & finite & F.exists(values, lambda v: v != 0)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    keep: int = 20,
    lists: int = 256,
    probes: int = 160,
    sample: int = 20_000,
    confidence: float = 2.1,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """For each row of ``queries`` its ``keep`` rows of ``vectors`` of largest inner product.

    Columns: ``query_id``, ``rank`` (from 1), ``id_column`` and ``score`` (the inner product of
    the original vectors in double precision); nearest first, ties to the smaller id. A
    query's own id never is its neighbour. All rows of ``vectors`` are indexed; centres and
    rotation come from the ``sample`` rows with the smallest hash of the id.

    Vectors that are null, zero, of another length than most of the others, or hold null or
    non-finite components take no part, nor do rows with a null id; a repeated id counts
    once (its smallest vector). Empty tables give no rows; other columns are left out.

    Equal vectors are one candidate: of each only the ``keep`` + 1 smallest ids can be
    among the nearest, so no more are expanded at the end; equal queries are searched once.
    Lists and the queries that probe them are cut into parts of bounded size, and each pair
    of parts is a task's group.
    """
    spark = vectors.sparkSession
    double = F.transform(F.col(vector_column), lambda v: v.cast("double"))

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_column).cast("long").alias("id"), double.alias("v"))
        return rows.where(F.col("id").isNotNull() & _valid("v")).groupBy("id").agg(F.min("v").alias("v"))

    every = stored(clean(vectors), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    picked = every.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    schema = f"query_id bigint, rank int, {id_column} bigint, score double"
    if not picked:
        return spark.createDataFrame([], schema)
    # The width of most vectors, the larger of equally frequent ones.
    widths = every.groupBy(F.size("v").alias("width")).count()
    widths = widths.orderBy(F.desc("count"), F.desc("width")).limit(2).collect()
    width = widths[0]["width"]
    if len(widths) > 1:
        every = every.where(F.size("v") == width)
        picked = every.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    points = np.array([r["v"] for r in picked])
    longest = float(np.sqrt(every.agg(F.max(length)).first()[0]))
    index = spark.sparkContext.broadcast(fit_lists(points, lists, longest))

    # One row per distinct vector, with its smallest ids.
    hashed = every.withColumn("h", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))
    smallest = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    ranked = hashed.withColumn("_n", smallest).where(F.col("_n") <= keep + 1)
    owners = stored(ranked.select("h", "id", "_n", "v"), "vector-owners")
    distinct = owners.where("_n = 1").select("h", "v")

    wanted = keep + 1

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = index.value
        for batch in batches:
            points = np.stack(batch["v"].to_numpy())
            rotated = found.place(points)
            yield pd.DataFrame(
                {
                    "h": batch["h"],
                    "v": batch["v"],
                    "list": found.nearest_lists(rotated, 1)[:, 0].astype(np.int32),
                }
            )

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = index.value
        for batch in batches:
            turned = found.query(np.stack(batch["v"].to_numpy()))
            near = found.nearest_lists(turned, probes).astype(np.int32)
            radii = found.radii(turned, near, wanted)
            yield pd.DataFrame({"h": batch["h"], "v": batch["v"], "radius": radii, "lists": list(near)})

    assigned = stored(
        distinct.mapInPandas(assign, "h string, v array<double>, list int"), "vector-lists"
    )
    asked_rows = stored(clean(queries).where(F.size("v") == width), "query-vectors").withColumn(
        "h", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))))
    )
    asked = asked_rows.groupBy("h").agg(F.min("v").alias("v"))
    probed = stored(
        asked.mapInPandas(probe, "h string, v array<double>, radius double, lists array<int>"),
        "query-lists",
    ).select("h", "v", "radius", F.explode("lists").alias("list"))
    # One row per list: as many as there are centres.
    sizes = assigned.groupBy("list").agg(F.ceil(F.count("*") / _LIST_PART).cast("int").alias("lp"))
    loads = probed.groupBy("list").agg(F.ceil(F.count("*") / _QUERY_PART).cast("int").alias("qp"))
    parts = F.broadcast(sizes.join(loads, "list"))
    left = assigned.join(parts, "list").select(
        "list",
        F.pmod(F.xxhash64("h"), "lp").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("qp") - 1)).alias("j"),
        "h",
        "v",
    )
    right = probed.join(parts, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("lp") - 1)).alias("i"),
        F.pmod(F.xxhash64("h"), "qp").cast("int").alias("j"),
        "h",
        "v",
        "radius",
    )

    def compare(stored_part: pd.DataFrame, query_part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(stored_part) and len(query_part):
            found = index.value
            names = stored_part["h"].to_numpy()
            points = np.stack(stored_part["v"].to_numpy())
            rotated = found.place(points)
            columns = [
                np.ascontiguousarray(rotated[:, i : i + _COLUMNS])
                for i in range(0, rotated.shape[1], _COLUMNS)
            ]
            asked = np.stack(query_part["v"].to_numpy())
            turned, radii = found.query(asked), query_part["radius"].to_numpy()
            labels = query_part["h"].to_numpy()
            for i in range(0, len(asked), _QUERIES):
                q, c = scan(turned[i : i + _QUERIES], radii[i : i + _QUERIES], columns, wanted, confidence)
                scores = (points[c] * asked[q + i]).sum(axis=1)
                out.append(pd.DataFrame({"q": labels[q + i], "h": names[c], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "h": [], "score": []})

    keys = ["list", "i", "j"]
    matches = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(compare, "q string, h string, score double")
    )
    best = F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))
    near = stored(matches.withColumn("_r", best).where(F.col("_r") <= wanted), "vector-matches")
    expanded = near.join(owners.select("h", "id"), "h")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = expanded.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= wanted)
    top = stored(top.select(F.col("q").alias("h"), "id", "score"), "vector-nearest")
    answers = salted_join(
        asked_rows.select(F.col("id").alias("query_id"), "h"), top, ["h"], ["query_id"]
    ).where("query_id <> id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (
        answers.withColumn("rank", place)
        .where(F.col("rank") <= keep)
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )
