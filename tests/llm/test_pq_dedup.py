import numpy as np

from docaudit.llm import pq_dedup as Q
from docaudit.llm.pq_dedup import pq_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id string, raw int"


def brute(ids, x, threshold=0.95):
    length = np.sqrt((x * x).sum(axis=1))
    on = (x @ x.T) / (length[:, None] * length[None]) >= threshold
    np.fill_diagonal(on, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], *label[on[i]]) if on[i].any() else label[i] for i in range(len(ids))])
        if (new == label).all():
            return on.sum(axis=1), label
        label = new


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], None, "x", 1) for i, row in zip(ids, x)], SCHEMA)


def planted(seed=2, dims=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, dims))
    for k, (n, noise) in enumerate(((30, 0.02), (12, 0.15), (8, 0.25), (60, 0.05))):
        centre = rng.normal(size=dims)
        x[k * 60 : k * 60 + n] = centre + noise * rng.normal(size=(n, dims)) * np.sqrt((centre**2).mean())
    x[399] = 3 * x[398]  # the same direction
    x[397] = x[396]  # a copy
    return x.astype(np.float32)


def test_recall_and_nothing_false(spark):
    x = planted()
    ids = np.arange(400) + 7
    links, label = brute(ids.tolist(), x.astype(float))
    got = {r.vec_id: r for r in pq_dedup(frame(spark, ids, x)).collect()}
    mine = np.array([got[i].n_links for i in ids])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum() and links.sum() > 500
    assert np.mean([got[i].component_id == c for i, c in zip(ids, label)]) > 0.99
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_one_dense_group_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 24))
    x[100:350] = rng.normal(size=24) + 0.1 * rng.normal(size=(250, 24))
    x = x.astype(np.float32)
    links, label = brute(list(range(500)), x.astype(float))
    got = {r.vec_id: r for r in pq_dedup(frame(spark, range(500), x)).collect()}
    mine = np.array([got[i].n_links for i in range(500)])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(500)]) > 0.99


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]),
        (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, -0.0]), (11, [-1.0, 0.0]), (12, [2.0, 0.1]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq_dedup(df).collect() if r.vec_id is not None)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11)]
    group = [(7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (10, 4, 7, False), (12, 4, 7, False)]
    assert got == sorted(alone + group)
    assert pq_dedup(df).count() == len(rows)
    assert pq_dedup(df.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    import random

    from docaudit.llm.common import components

    rng = random.Random(3)
    for n, m in ((1, 0), (30, 20), (200, 190), (50, 300)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 3)]
        label = list(range(n))
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        used = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: label[x] for x in used}
