import random

import numpy as np
from cases import awkward, empty, words

from docaudit.llm.mixing import FIT, fit, mix_sources, nearest_sum, take_mix


def plain_targets(sizes, weights=(1, 2, 3)):
    left, total, open_ = dict(sizes), float(sum(sizes.values())), {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    open_ = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = {}
    while True:
        level = total / sum(open_.values()) if open_ else 0
        over = [s for s in open_ if open_[s] * level > 3 * left[s] + 1e-9]
        if not over:
            return out | {s: w * level for s, w in open_.items()}
        for s in over:
            out[s] = 3.0 * left[s]
            total -= 3 * left[s]
            del open_[s]


def test_nearest_sum_is_the_best_there_is():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        goal = rng.randint(0, 90)
        sums = {0}
        for size, n in zip(lengths, counts):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        got = nearest_sum(np.array(lengths), np.array(counts), goal)
        assert (got <= counts).all() and (got >= 0).all()
        assert abs(int((got * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_fit_beyond_the_programme_s_range():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 3000, 400))
    counts = rng.integers(1, 60, len(lengths))
    have = int((lengths * counts).sum())
    assert have > 100 * FIT
    for target in (0.4321 * have, 1.7 * have, 2.999 * have, 3 * have):
        repeats, extra = fit(lengths, counts, target)
        assert abs(repeats * have + int((extra * lengths).sum()) - target) <= 1
        assert (extra <= counts).all() and repeats <= 3


def test_awkward_rows_and_rerun(spark):
    df = awkward(spark)
    rows = mix_sources(df).collect()
    assert len(rows) == df.count()
    source = {}
    for r in df.collect():
        source[r.source] = source.get(r.source, 0) + len(words(r.text))
    want = plain_targets(source)
    by_id = {r.doc_id: r.source for r in df.collect() if r.doc_id is not None}
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0) <= (r.taken == 0)
        if r.doc_id is not None:
            assert abs(r.target - want[by_id[r.doc_id]]) < 1e-6 and r.source_size == source[by_id[r.doc_id]]
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(df).collect()))
    assert mix_sources(empty(spark)).count() == 0


def test_mix_takes_whole_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = mix_sources(docs)
    taken = {r.doc_id: (r.taken, r.size) for r in mixed.collect()}
    rows = take_mix(docs, mixed)
    assert rows.columns == docs.columns
    seen = {}
    for r in rows.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len(words(r.text))
    assert seen == {k: t for k, (t, _) in taken.items() if t}
    per = {}
    for r in mixed.join(docs.select("doc_id", "source"), "doc_id").collect():
        per.setdefault(r.source, []).append((r.size, r.taken, r.target))
    for rows in per.values():
        sizes, target = [s for s, _, _ in rows], rows[0][2]
        whole = min(3, round(target) // sum(sizes))
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums}
        best = min(abs(whole * sum(sizes) + (x if whole < 3 else 0) - round(target)) for x in sums)
        assert abs(sum(t for _, t, _ in rows) - round(target)) == best
    assert take_mix(empty(spark), mix_sources(empty(spark))).count() == 0
