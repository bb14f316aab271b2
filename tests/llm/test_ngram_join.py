import random

import numpy as np
from cases import awkward, empty, folded, words

from docaudit.llm import ngram_join as N
from docaudit.llm.ngram_join import common_sizes, minhash, needed, ngram_join


def shingle_set(text):
    w = words(folded(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_join(rows, threshold=0.8):
    """(id, class, links) of every row, by comparing all of them."""
    sets = [shingle_set(t) if i is not None else set() for i, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    # rows of one id are one document
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in [*link[i], *[k for k in range(n) if rows[k][0] is not None and rows[k][0] == rows[i][0] and sets[i] and sets[k]]]:
                low = min(label[i], label[j])
                if label[i] != low or label[j] != low:
                    label[i] = label[j] = low
                    changed = True
    return sorted(str((rows[i][0], label[i], len(link[i]))) for i in range(n))


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    got = sorted(str((r.doc_id, r.class_id, r.n_links)) for r in ngram_join(df).collect())
    assert got == plain_join(rows)


def near_copies(rng, n):
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(12)
    texts = [t for n in (2, 3, 9, 60) for t in near_copies(rng, n)]
    texts += [texts[0], texts[5].upper(), "a b c", "A b C", "a b c d"]
    # a passage that many otherwise different texts share
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 40, 200]))) for _ in range(40)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 1500)
    rng = random.Random(13)
    check(spark, list(enumerate(near_copies(rng, 40) + near_copies(rng, 5))))


def test_awkward_rows(spark):
    df = awkward(spark)
    check(spark, [(r.doc_id, r.text) for r in df.collect()], df)
    assert ngram_join(empty(spark)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    assert needed(0.8, 1e-6) == [5, 14, 24, 35, 46, 57, 68, 80]
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**63, 900, dtype=np.uint64)
        b = np.concatenate([a[:801], rng.integers(0, 2**63, 99, dtype=np.uint64)])
        x, _ = N.surviving(minhash(a)[None], minhash(b)[None], needed(0.8, 1e-6))
        assert len(x) == 1
    x, _ = N.surviving(minhash(a)[None], minhash(rng.integers(0, 2**63, 900, dtype=np.uint64))[None], needed(0.8, 1e-6))
    assert not len(x)


def test_intersections_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(30)]
    a, b = np.arange(12), np.arange(12, 30)
    x, y = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]
    assert common_sizes(sets, a, b, x, y).tolist() == want
    assert common_sizes(sets, a, b, x[:5], y[:5]).tolist() == want[:5]
