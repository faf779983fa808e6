"""Space-filling curves and nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asks):
    fine = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            fine[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in fine:
        if asks(q):
            near = sorted(((-float(fine[q] @ v / (np.sqrt(fine[q] @ fine[q]) * np.sqrt(v @ v))), i) for i, v in fine.items() if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    hot = rows[50][1]
    rows += [(1000 + i, hot, 1) for i in range(60)] + [(900, [-x for x in hot], 0)]
    rows += [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [1.0, None] * 4, 0), (2150, [float("nan")] * 8, 0), (2200, [float("inf")] * 8, 0),
             (2250, [1.0] * 3, 0), (None, hot, 0), (2300, [], 0), rows[0], rows[0]]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0, 5).collect()
    want = brute(rows, 5, lambda q: q % 50 == 0)
    assert {(r["query_id"], r["rank"]) for r in got} == {(q, i + 1) for q, v in want.items() for i in range(len(v))}
    for r in got:
        i, s = want[r["query_id"]][r["rank"] - 1]
        assert abs(r["score"] - s) < 1e-9
        if r["query_id"] == 50 or r["query_id"] >= 1000:
            assert r["vec_id"] == i


def test_fewer_rows_than_neighbours_and_empty_tables(spark):
    one = spark.createDataFrame([(50, [1.0, 2.0], 0)], VECTORS)
    assert neighbours.nearest(one, F.col("id") % 50 == 0).collect() == []
    two = spark.createDataFrame([(50, [1.0, 2.0], 0), (51, [2.0, 1.0], 0)], VECTORS)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(two, F.col("id") % 50 == 0).collect()] == [(50, 1, 51)]
    assert neighbours.nearest(one.limit(0), F.col("id") % 50 == 0).collect() == []


def test_windows_find_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 128)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=32)], 0) for i in range(4000)]
    assert neighbours.recall(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0) >= 0.9


def test_the_searched_share_follows_the_table(spark, monkeypatch):
    # 24 orderings of three windows hold 2,304 of these 12,000 vectors at most.
    monkeypatch.setattr(neighbours, "WINDOW", 32)
    monkeypatch.setattr(neighbours, "LARGEST", 800, raising=False)
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.normal(size=32)], 0) for i in range(12000)]
    assert neighbours.recall(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0) >= 0.9


def test_crowded_third_is_searched_as_well(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 128)
    rng = np.random.default_rng(12)
    center = rng.normal(size=32)
    for noise in (0.05, 0.005):
        rows = [(i, [float(x) for x in (center + noise * rng.normal(size=32) if i % 3 == 0 else rng.normal(size=32))], 0) for i in range(6000)]
        assert neighbours.recall(spark.createDataFrame(rows, VECTORS), F.col("id") % 150 == 0) >= 0.9


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dim, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
