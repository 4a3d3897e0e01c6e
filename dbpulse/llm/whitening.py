"""Embedding whitening by polarisation: covariances from variances alone, in whole numbers.

An entry c becomes the whole number ``x = floor(1024 * c) + 100000``. With S the sum of a
dimension over n vectors and m the whole number nearest S / n, ``d = x - m`` is small and
``n * x - S = n * d - r`` with ``r = S - n * m``. So the squared centred value of a dimension,
or of the sum of two dimensions, summed over all vectors is

    sum (n * d - r) ** 2  =  n * n * sum(d ** 2)  -  n * r ** 2

exactly, where d and r of a pair are the sums of both dimensions'. Tasks add up squares of
small centred numbers in 64 bits, Spark adds the tasks' partial sums as decimals, and the last
step is whole numbers of any size. Polarisation then gives every cross-covariance as half of
``var(i + j) - var(i) - var(j)``, still exact; only the division by n cubed rounds, once. The
matrix, as large as the number of dimensions squared whatever the number of vectors, is
decomposed by ``eigh``.

Each pass reads the vectors where they lie and leaves one partial sum per task and pair of
dimensions; no vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: entries whose scaled value needs more bits have no exact double and count as not finite
LARGEST = 2.0**52
ROWS_AT_ONCE = 4_096
LIMB = 60
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """What the fit list gives: ``n`` vectors, middles and rests of each dimension, unit directions by falling eigenvalue."""

    n: int
    middle: np.ndarray
    rest: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float


def whole_entries(vector: Column) -> Column:
    """The vector's entries as whole numbers; null where it is null or holds null or non-finite entries."""
    c = F.transform(vector.cast("array<double>"), lambda e: e * SCALE)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= LARGEST))
    return F.when(~bad, F.transform(c, lambda e: F.floor(e).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(column: pa.Array) -> Iterator[np.ndarray]:
    for at in range(0, len(column), ROWS_AT_ONCE):
        yield _matrix(column.slice(at, ROWS_AT_ONCE))


def _added(held: dict, key, value) -> None:
    held[key] = held.get(key, 0) + value


def _sums(xs: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of vector: how many there are and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(0)])
            for size in np.unique(sizes).tolist():
                x = _matrix(batch.column(0).take(pa.array(np.flatnonzero(sizes == size))))
                _added(held, (size, -1), len(x))
                for i, s in enumerate(x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 2**40 else x.sum(axis=0).tolist()):
                    _added(held, (size, i), int(s))
        yield from _sent(held)

    return _collected(xs, run)


def _sent(held: dict) -> Iterator[pa.RecordBatch]:
    # sums in two limbs, the upper as text, since they may need more than 64 bits
    keys = [pa.array([k[at] for k in held], pa.int64()) for at in (0, 1)]
    limbs = [pa.array([str(v >> LIMB) for v in held.values()], pa.string()), pa.array([v & 2**LIMB - 1 for v in held.values()], pa.int64())]
    yield pa.RecordBatch.from_arrays([*keys, *limbs], ["a", "b", "high", "low"])


def _collected(xs: DataFrame, run) -> dict[tuple[int, int], int]:
    """The tasks' sums by key, added up on the cluster; as many as there are keys, not rows."""
    parts = xs.mapInArrow(run, "a long, b long, high string, low long")
    added = parts.groupBy("a", "b").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    return {(r.a, r.b): (int(r.high) << LIMB) + int(r.low) for r in added.collect()}


def _squares(xs: DataFrame, middle: np.ndarray) -> dict[tuple[int, int], int]:
    """The sum of ``d ** 2`` of every dimension ``(i, i)`` and of every sum of two, ``(i, j)``."""
    dims = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for x in _parts(batch.column(0)):
                d = x - middle
                small = np.abs(d).max(initial=0) < 2**24
                d = d if small else d.astype(object)
                for i in range(dims):
                    pair = d[:, i:] + d[:, i : i + 1]
                    pair[:, 0] = d[:, i]
                    for j, s in enumerate((pair * pair).sum(axis=0).tolist(), i):
                        _added(held, (i, j), int(s))
        yield from _sent(held)

    return _collected(xs, run)


def fit(xs: DataFrame) -> Fit | None:
    """The exact covariance of ``xs(x)`` and its decomposition; None where there is no vector.

    Vectors of the most frequent length (of several, the longest) are the fit list.
    """
    sums = _sums(xs)
    counts = {size: n for (size, i), n in sums.items() if i == -1 and size > 0}
    if not counts:
        return None
    size = max(counts, key=lambda k: (counts[k], k))
    n, total = counts[size], [sums[size, i] for i in range(size)]
    middle = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, middle)]
    squares = _squares(xs.filter(F.size("x") == size), np.array(middle, np.int64))

    def centred(i: int, j: int) -> int:
        r = rest[i] + rest[j] if i != j else rest[i]
        return n * n * squares[i, j] - n * r * r

    v = np.zeros((size, size))
    for i in range(size):
        v[i, i] = centred(i, i) / n**3
        for j in range(i + 1, size):
            v[i, j] = v[j, i] = (centred(i, j) - centred(i, i) - centred(j, j)) // 2 / n**3
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return Fit(n, np.array(middle, np.int64), np.array(rest, np.int64), vectors * signs, values, float(np.trace(v)))


def _whitened(x: np.ndarray, model: Fit, k: int) -> np.ndarray:
    """``x - S / n`` on the first ``k`` directions, over the root of their eigenvalues."""
    return ((x - model.middle) - model.rest / model.n) @ model.directions[:, :k] / np.sqrt(model.values[:k])


def _deviation(x: np.ndarray, model: Fit) -> list[int]:
    """The sum over dimensions of ``(n * x - S) ** 2`` of each row, exact."""
    d, n = x - model.middle, model.n
    far = int(np.abs(d).max(initial=0))
    d = d if max(far, n) * max(far, 1) * len(model.middle) < 2**62 else d.astype(object)
    rest = sum(int(r) ** 2 for r in model.rest)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip((d * d).sum(axis=1), (d * model.rest).sum(axis=1))]


def _identity_error(xs: DataFrame, model: Fit, k: int) -> float | None:
    """The largest absolute entry of the covariance of what is really given out, minus the identity."""
    if not k:
        return None
    shared = xs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = np.zeros((k + 1, k + 1)), Fit(*shared.value)
        for batch in batches:
            for x in _parts(batch.column(0)):
                w = np.column_stack((_whitened(x, own, k), np.ones(len(x))))
                held += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(held[i, j])], ["a", "b", "s"])

    sums = xs.mapInArrow(run, "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    s = {(r.a, r.b): r.s / model.n for r in sums}
    return max(abs(s[i, j] - s[i, k] * s[j, k] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``RESULT`` columns: a row for each usable vector and each of the first ``components`` directions.

    Dropped are vectors that are null or empty, hold null or non-finite entries (entries of
    2**52 / 1024 or more count as such, having no exact whole number here), or whose length
    is not the most frequent one (of several, the longest): one matrix has one number of
    dimensions. All others are the fit list; repeated rows count each and null ids are ids
    like others. ``deviation`` is exact (null
    beyond 38 digits). Directions are unit eigenvectors whose largest entry
    is positive, numbered from 1 by falling eigenvalue. Where an eigenvalue is no more than
    rounding (1e-12 of the largest; all are where every vector is the same) there is nothing to
    divide by: ``whitened`` is null, and ``identity_error`` leaves such directions out (null if
    there is no other). ``explained`` is null if all variance is zero. Further columns are
    ignored; without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole_entries(F.col(f"`{vector_col}`")).alias("x"))
    xs = rows.filter("x is not null").select("x")
    model = fit(xs)
    if model is None:
        return spark.createDataFrame([], RESULT)
    size = len(model.middle)
    many = min(components, size)
    k = int((model.values[:many] > 1e-12 * max(model.values[0], 0)).sum()) if model.values[0] > 0 else 0
    error = _identity_error(xs.filter(F.size("x") == size), model, k)
    explained = (model.values[:many] / model.trace).tolist() if model.trace > 0 else [None] * many
    shared = spark.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fit(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = _matrix(part.column(1))
                w = np.full((len(x), many), np.nan)
                w[:, :k] = _whitened(x, own, k)
                spread = pa.array(np.repeat(np.arange(len(x)), many))
                deviation = pa.array([str(v) for v in _deviation(x, own)], pa.string()).take(spread)
                columns = [part.column(0).take(spread), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), deviation, pa.array(w.ravel(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened"])

    found = rows.filter(F.size("x") == size).mapInArrow(run, "vec_id long, component int, deviation string, whitened double")
    share = F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("component") - 1)
    return found.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
