"""Whitening of embeddings by shifted CholeskyQR (operator 11).

Entries become whole numbers x = floor(64 c) + 1000000, so the sums S and the centred rows (n x - S) / n carry no error
but that of one division.  With A the centred rows, R of A = QR is found without ever holding Q:

1. A Gram pass adds up Q'Q over all rows, task by task, and the sums of the tasks by cell.  Q is A at first; later each
   row of A is run through the triangular factors found so far by substitution.
2. The driver, which sees d x d numbers only, takes the Cholesky factor of the Gram matrix, shifted by a multiple of its
   norm in the first pass and wherever it is not positive definite otherwise.  Shifted factors leave Q well conditioned,
   so the passes after them bring it to orthonormal columns; passes end when the Gram matrix is the identity up to
   rounding, after three for most tables.
3. The factors multiplied are R.  Its singular values s and right vectors v give the covariance's eigenvalues s^2 / n and
   its components, more exactly than the covariance itself would, as nothing is squared.
4. One more pass measures how far the whitened rows' covariance is from the identity.

No pass shuffles rows: each task sends d (d + 1) / 2 numbers to the sum.  ``d`` is the commonest length of a vector.

Defined results: vectors that are null or empty, hold a null or non-finite entry or one of 2^46 or more, or have
another length than most (of equally common ones the longer) take no part; null and repeated ``vec_id`` come back as often
as they came in; equal rows count each; directions without variance (singular value under 1e-12 of the largest) have no
component, so a table of equal vectors, of one or of none gives no rows; of equal eigenvalues any basis may come, the
same for all rows; a component's largest entry is positive; ``deviation`` is null where it does not fit a long; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

SCALE, SHIFT = 64, 1_000_000
# Entries from here on are no whole numbers once scaled.
LARGEST = float(1 << 46)
# Gram passes at most, and how far from the identity a Gram matrix may be at the end.
PASSES, ORTHONORMAL = 10, 1e-12
RANK = 1e-12


class Whitening(NamedTuple):
    """Row count, sums, components as columns, their eigenvalues, the trace of the covariance, and the identity's error."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(key, x) of the vectors that take part, and their length."""
    own = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("c"))

    def usable(c: Column) -> Column:
        # A NaN is larger than any number in Spark.
        return c.isNotNull() & (F.abs(c) < LARGEST)

    fit = own.filter(F.forall("c", usable) & (F.size("c") > 0))
    common = fit.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    whole = F.transform("c", lambda c: F.floor(SCALE * c) + F.lit(SHIFT))
    return fit.filter(F.size("c") == d).select(key, whole.alias("x")), d


def _cell_sums(rows: DataFrame, cells: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, float]:
    """Sums over all rows, by cell, of what ``cells`` gives for a block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = cells(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "value"])

    found = rows.select("x").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in found.collect()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they fit, Python's numbers otherwise."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return np.asarray(deviations(x, n, sums) / n, np.float64)


def right_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, column after column."""
    turned, out = rows.T, np.empty(rows.shape[::-1])
    for j in range(len(r)):
        out[j] = (turned[j] - r[:j, j] @ out[:j]) / r[j, j]
    return out.T


def _symmetric(found: dict[int, float], d: int) -> np.ndarray:
    matrix = np.zeros((d, d))
    upper = np.triu_indices(d)
    matrix[upper] = [found[k] for k in range(len(upper[0]))]
    return matrix + np.triu(matrix, 1).T


def gram(rows: DataFrame, n: int, sums: list[int], factors: list[np.ndarray]) -> np.ndarray:
    """Q'Q for the centred rows after substitution through ``factors``."""
    upper = np.triu_indices(len(sums))

    def cells(x: np.ndarray) -> np.ndarray:
        q = centred(x, n, sums)
        for r in factors:
            q = right_solve(q, r)
        return (q.T @ q)[upper]

    return _symmetric(_cell_sums(rows, cells, "double"), len(sums))


def _factor(matrix: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor, of the shifted matrix if asked for or needed."""
    d, norm = len(matrix), np.linalg.norm(matrix, 2)
    shift = min(11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2, 0.01) * norm
    while True:
        try:
            return np.linalg.cholesky(matrix + (shift if shifted else 0.0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift, shifted = shift * (10 if shifted else 1), True


def triangular_factor(rows: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, float]:
    """R of the centred rows, and the sum of their squares."""
    factors: list[np.ndarray] = []
    r, squares = np.eye(len(sums)), 0.0
    for turn in range(PASSES):
        matrix = gram(rows, n, sums, factors)
        if not turn:
            squares = float(np.trace(matrix))
            if not squares:
                break
        if np.abs(matrix - np.eye(len(matrix))).max() <= ORTHONORMAL:
            break
        factors.append(_factor(matrix, n, shifted=not turn))
        r = factors[-1] @ r
    return r, squares


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    k = len(model.eigenvalues)
    upper = np.triu_indices(k)

    def cells(x: np.ndarray) -> np.ndarray:
        w = whitened(x, model)
        return np.concatenate([(w.T @ w)[upper], w.sum(axis=0)])

    found = _cell_sums(rows, cells, "double")
    mean = np.array([found[len(upper[0]) + j] for j in range(k)]) / model.n
    return float(np.abs(_symmetric(found, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.eigenvalues)


def fit(rows: DataFrame, d: int, components: int = 32) -> Whitening | None:
    """The whitening of (x) rows of ``d`` entries, or None where nothing varies."""
    if not d:
        return None
    found = _cell_sums(rows, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n, sums = found[d], [found[j] for j in range(d)]
    r, squares = triangular_factor(rows, n, sums)
    if not squares:
        return None
    _, singular, vectors = np.linalg.svd(r)
    k = min(components, int((singular > RANK * singular[0]).sum()))
    vectors = vectors[:k].T
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    model = Whitening(n, sums, vectors, singular[:k] ** 2 / n, squares / n)
    return model._replace(identity_error=_identity_error(rows, model))


def _exact_squares(deviation: np.ndarray) -> list[int | None]:
    """Sum of squares of each row as a long, null where it is none."""
    if deviation.dtype != object and deviation.shape[1] * int(np.abs(deviation).max(initial=0)) ** 2 < 1 << 63:
        return (deviation * deviation).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in deviation.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    kind = vectors.schema[key].dataType.simpleString()
    found, d = whole_vectors(vectors, key, vector)
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(found, "vectors")
    model = fit(rows, d, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
            place = pa.array(np.repeat(np.arange(m), k))
            squares = pa.array(_exact_squares(deviations(x, model.n, model.sums)), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                squares.take(place), pa.array(whitened(x, model).reshape(-1)), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, model.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col(key), "x").mapInArrow(run, schema)
