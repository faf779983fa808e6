"""Whitening against numpy's eigenvectors and exact whole-number sums."""

import os

import numpy as np
import pytest
from pyspark.sql import types as T

from pagemill.llm import queries, whitening

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def expected(vectors, components=32):
    """n, exact deviations, whitened rows up to signs, explained shares."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(v) ** 2 for v in row) for row in (x * n - sums)]
    rows = np.array((x * n - sums) / n, dtype=np.float64)
    values, columns = np.linalg.eigh(rows.T @ rows / n)
    order = np.argsort(-values)[:components]
    return n, deviation, rows @ columns[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(got, ids, vectors, components=32, tolerance=1e-8):
    n, deviation, rows, explained = expected(vectors, components)
    k = len(explained)
    table = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(table) == len(ids) * k
    ours = np.array([[table[i, j]["whitened"] for j in range(1, k + 1)] for i in ids])
    ours *= np.sign((ours * rows).sum(axis=0))
    assert np.abs(ours - rows).max() < tolerance
    assert all(r["n"] == n and r["deviation"] == deviation[ids.index(r["vec_id"])] for r in got)
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 for r in got)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 8)) * [9, 5, 3, 2, 1.5, 1, 0.7, 0.5] @ rng.normal(size=(8, 8)) + 5).astype(np.float32)
    rows = [(i, v.tolist(), "x", 9) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(whitening.whiten(docs).collect(), list(range(300)), vectors)
    check(whitening.whiten(docs, components=3).collect(), list(range(300)), vectors, 3)


def test_ill_conditioned_rows_need_the_shift(spark):
    """Columns from 1e-2 to 1e6, two of them nearly alike: a plain Cholesky factor of the Gram matrix is not enough."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 1)) * 1e6
    vectors = np.hstack([base, base + rng.normal(size=(400, 1)) * 0.1, rng.normal(size=(400, 2)) * [50, 0.5]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    rows, d = whitening.whole_vectors(frame)
    model = whitening.fit(rows, d)
    x = np.floor(64 * vectors) + 1_000_000
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / 400
    assert np.abs(model.eigenvalues / values - 1).max() < 1e-6 and model.identity_error < 1e-6


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = rng.normal(size=(10, 6))
    assert np.allclose(whitening.right_solve(rows, r) @ r, rows)


def test_defined_results(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 3)).astype(np.float32)
    good = [(i, v.tolist(), None, 1) for i, v in enumerate(vectors)]
    bad = [(100, None, "x", 1), (101, [1.0, None, 2.0], "x", 1), (102, [1.0, float("nan"), 2.0], "x", 1), (103, [float("inf"), 1.0, 2.0], "x", 1),
           (104, [-float("inf"), 1.0, 2.0], "x", 1), (105, [], "x", 1), (106, [1.0, 2.0], "x", 1), (107, [1e30, 1.0, 2.0], "x", 1), (None, None, None, None)]
    check(whitening.whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(4)).collect(), list(range(40)), vectors)
    # Repeated rows and null ids count and come back each.
    twice = spark.createDataFrame([*good, *good, (None, [0.5, 0.5, 0.5], "x", 1)], SCHEMA)
    got = whitening.whiten(twice).collect()
    assert len(got) == 81 * 3 and {r["n"] for r in got} == {81} and sum(r["vec_id"] is None for r in got) == 3
    # No variance: no component.
    for rows in ([], good[:1], [(i, [1.0, 2.0], "x", 1) for i in range(9)], bad):
        empty = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert empty.collect() == [] and empty.columns[:2] == ["vec_id", "component"]
    # A constant and a repeated column leave one component.
    flat = [(i, [float(v[0]), 7.0, float(v[0])], "x", 1) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9


def test_sums_beyond_a_long(spark):
    rows = [(i, [float(s) * (1 << 45), float(i)]) for i, s in enumerate([1, -1, 0.5, 0.25] * 50)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    got = whitening.whiten(frame).collect()
    assert len(got) == 400 and {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_query_equals_numpy(spark):
    rows = [r for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = queries.op11_cholesky_whitening(spark, SF_DIR).collect()
    check(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows], tolerance=1e-6)
