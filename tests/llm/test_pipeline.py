"""Each stage of the pipeline against a brute-force version on its own input, and the whole run."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from cases import awkward, empty, folded, words
from test_ngram_join import plain_join
from tokenizers import Tokenizer

from docaudit.llm import quality
from docaudit.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut_lineage(stage(spark, docs, SF), "stage")
        kept.append((name, before, docs.collect()))
    (_, a, good), (_, b, exact), (_, c, near), (_, d, mixed), (_, e, tokens) = kept

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in good}
    clean = [r.doc_id for r in a if labels.get(r.doc_id) == 1]
    assert np.mean([i in ids for i in clean]) > 0.97 and not any(i in ids and labels[i] == 0 for i in labels)

    last = {}
    for r in b:
        last[folded(r.text)] = max(r.doc_id, last.get(folded(r.text), -1))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())

    classes = [eval(x) for x in plain_join([(r.doc_id, r.text) for r in c])]
    assert sorted(r.doc_id for r in near) == sorted({k for _, k, _ in classes})

    size = {}
    for r in d:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    from test_mixing import plain_targets

    longest = max(len(words(r.text)) for r in d)
    assert all(abs(taken.get(s, 0) - t) <= max(1, longest) for s, t in plain_targets(size).items())

    theirs = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    n = sorted((r.doc_id, r.n_tokens) for r in tokens)
    assert n == sorted((r.doc_id, len(theirs.encode(r.text, add_special_tokens=False).ids)) for r in e)


def test_run_and_columns(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 50 < out.count()


def test_awkward_and_empty_input(spark):
    for docs in (awkward(spark), empty(spark)):
        columns = docs.columns
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = cut_lineage(stage(spark, docs, SF), "stage")
            if n + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns


def test_rows_that_share_or_lack_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(1, long), (2, long + " near"), (2, other), (3, long + " twin"), (None, long + " none"), (None, other + " x y z " * 20), (5, "u " * 8), (5, "u " * 8 + "near " * 9), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cut_lineage(corpus_pipeline.dedup_near(spark, docs, SF), "stage")
    assert {(r.doc_id, r.text) for r in kept.collect()} == {x for x in rows if x[0] == 1 or (x[0] is not None and not (x[1] or "").startswith("w0"))}
    pair = spark.createDataFrame([(7, long, "en", "a", 0), (7, long + " near", "en", "a", 0)], docs.schema)
    assert corpus_pipeline.dedup_near(spark, pair, SF).count() == 1

    # sources a, b, c at weights 1, 2, 3: half of a's rows go, rows that share or lack an id too
    parts = [(i if i % 3 else None if i % 2 else 4, f"{s} " * 9 + f"{s}{i}", "en", s, 0) for s in "abc" for i in range(40)]
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(parts, docs.schema), SF).collect()
    from test_mixing import plain_targets

    for s, goal in plain_targets({s: 400 for s in "abc"}).items():
        own = [r.text for r in mixed if r.source == s]
        assert abs(10 * len(own) - goal) <= 10 and max(own.count(t) for t in own) - min(own.count(t) for t in own) <= 1, s
