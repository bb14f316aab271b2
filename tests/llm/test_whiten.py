import numpy as np

from docaudit.llm import whiten as W
from docaudit.llm.whiten import whiten

SCHEMA = "vec_id long, embedding array<float>, id string, x int, row int, block int, n string, white int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, "y", 4) for i, v in rows], SCHEMA)


def brute(x, most=8):
    """x: long vectors.  (deviations, whitened, explained) by plain covariance and eigenvectors."""
    n, total = len(x), x.sum(axis=0)
    deviation = [sum(int(n * int(c) - int(s)) ** 2 for c, s in zip(row, total)) for row in x]
    centred = x - total / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return deviation, centred @ vectors / np.sqrt(values), values / np.trace(cov)


def longs(vectors):
    return np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000


def held(rows, ids, x):
    """Rows of the operator against brute force, one vector an id."""
    deviation, white, explained = brute(x)
    k = white.shape[1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    mine = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-9
    for i, d in zip(ids, deviation):
        for c in range(k):
            r = got[i, c + 1]
            assert int(r.deviation) == d and r.n == len(ids) and abs(r.explained - explained[c]) <= 1e-9 * explained[c] and r.identity_error < 1e-9


def test_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    ids, vectors = zip(*[(r.vec_id, r.embedding) for r in df.collect()])
    held(whiten(df).collect(), ids, longs(vectors))


def test_many_blocks_and_tasks(spark, monkeypatch):
    """Blocks of few rows, the last one not full, over many scan tasks; fewer components than 8."""
    monkeypatch.setattr(W, "LEAST", 7)
    rng = np.random.default_rng(11)
    for n, dims in ((203, 5), (64, 12), (7, 3), (50, 1)):
        x = (rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + 3).astype(np.float32)
        df = frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)]).repartition(9)
        held(whiten(df).collect(), list(range(n)), longs(x))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 3)).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(good)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, inf, 1.0]), (104, [-inf, 1.0, 1.0]), (105, [3e38, 1.0, 1.0])]
    got = whiten(frame(spark, rows + bad)).collect()
    held(got, list(range(40)), longs(good))
    # equal ids and null ids are rows of their own; an empty vector has no component
    again = whiten(frame(spark, [(None if i < 20 else 7, v) for i, v in rows] + [(9, [])])).collect()
    assert len(again) == 120 and {r.vec_id for r in again} == {None, 7}
    assert sorted(round(abs(r.whitened), 9) for r in again) == sorted(round(abs(r.whitened), 9) for r in got)


def test_without_variance(spark):
    """Copies alone: no variance, so no whitened value; one line of points: one live component."""
    rows = whiten(frame(spark, [(i, [0.5, -0.25]) for i in range(5)])).collect()
    assert len(rows) == 10 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in rows)
    rows = whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(6)])).collect()
    live = sorted(r.whitened for r in rows if r.component == 1)
    assert np.allclose(live, (np.arange(6) - 2.5) / np.sqrt(35 / 12)) and all(r.whitened is None for r in rows if r.component == 2)
    assert all(r.identity_error < 1e-9 for r in rows)


def test_lengths_are_fitted_apart_and_empty_table(spark):
    rng = np.random.default_rng(5)
    two, three = rng.normal(size=(30, 2)).astype(np.float32), rng.normal(size=(20, 3)).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(two)] + [(100 + i, [float(v) for v in row]) for i, row in enumerate(three)]
    got = whiten(frame(spark, rows)).collect()
    held([r for r in got if r.vec_id < 100], list(range(30)), longs(two))
    held([r for r in got if r.vec_id >= 100], list(range(100, 120)), longs(three))
    none = whiten(frame(spark, [(1, None)]).limit(0))
    assert none.count() == 0 and none.columns == whiten(frame(spark, [(1, None)])).columns
