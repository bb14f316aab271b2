import zlib

import numpy as np
import pyarrow as pa
from cases import awkward, empty

from docaudit.llm import langid, quality
from docaudit.llm.quality import estimate, keep_good, quantities


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward_rows(spark):
    df = awkward(spark)
    rows = langid.language_id(df).collect()
    assert len(rows) == df.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 11, 12))
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert langid.language_id(empty(spark)).count() == 0
    # nothing to learn from
    assert {r.lang_pred for r in langid.language_id(df.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_codewords_correct_a_wrong_bit():
    for n in (2, 4, 9, 40):
        codes = langid.codewords(n)
        apart = (codes[:, None] != codes[None]).sum(axis=2)
        assert apart[~np.eye(n, dtype=bool)].min() >= 3
        uniform = np.full(codes.shape, 1 / codes.shape[1])
        model = langid.Model([str(i) for i in range(n)], codes, uniform, np.vstack([np.eye(codes.shape[1]), np.zeros((1, codes.shape[1]))]))
        wrong = codes.astype(float)
        wrong[:, 0] *= -1
        assert (langid.decode(model, wrong)[0] == np.arange(n)).all()


def test_em_finds_planted_rates():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.85
    rates = np.array([[0.5, 0.01], [0.4, 0.02], [0.6, 0.01], [0.3, 0.005], [0.5, 0.02], [0.4, 0.01], [0.3, 0.01], [0.5, 0.01], [0.2, 0.01], [0.2, 0.95], [0.3, 0.9]])
    on = rng.random((len(good), len(rates))) < np.where(good[:, None], rates[:, 1], rates[:, 0])
    patterns, counts = np.unique(on, axis=0, return_counts=True)
    post, chance, share = estimate(patterns, counts.astype(float))
    assert abs(share - 0.85) < 0.02 and np.abs(chance - rates).max() < 0.05


def test_quantities_by_hand():
    texts = ["Aa bb, cc. dd", "x### y### x### x###", "one two\none two\none two", "", None, "WAS!! THE!!", "1 2 | 3"]
    raw_at = quality.row_chunks(pa.array(texts, pa.string()))
    _, n, raw, at = next(raw_at)
    words, q = quantities(raw, at)
    assert words.tolist() == [4, 4, 6, 0, 0, 2, 4]
    name = {k: i for i, (k, *_) in enumerate(quality.DEFECTS)}
    assert q[1, name["signs_per_word"]] == 3 and q[1, name["odd_words"]] == 1
    assert q[1, name["repeats_of_word_before"]] == 0.25 and q[1, name["different_words"]] == 0.5
    assert np.isclose(q[2, name["repeated_lines"]], 2 / 3) and q[5, name["capital_letters"]] == 1
    assert q[6, name["odd_words"]] == 0.25 and np.isclose(q[0, name["capital_letters"]], 1 / 8)


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97
    clean = [r for r in rows if r.quality == 1]
    assert np.mean([r.kept for r in clean]) > 0.98
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(docs).where("kept").collect()}


def test_quality_awkward_rows(spark):
    df = awkward(spark)
    rows = quality.quality(df).collect()
    assert len(rows) == df.count() and all(not r.kept and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 11))
    assert quality.quality(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0


def test_rows_without_id_are_learned_from(spark):
    """Sampling goes by id and text, so a table without ids, or with one id, is sampled like any other."""
    from pyspark.sql import functions as F

    from docaudit.llm import langid, quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for own in (F.lit(None).cast("long"), F.lit(1).cast("long")):
        same = docs.withColumn("doc_id", own)
        scorer, label, _ = quality.train(same, sample=100)
        assert scorer is not None and label
        model = langid.train(same.where("lang is not null"), sample=100)
        assert model is not None and len(model.langs) >= 4
        said = langid.predict(docs, model).join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'")
        assert said.where("lang = lang_pred").count() > 0.9 * said.count()
    copies = docs.limit(1).crossJoin(spark.range(3000)).withColumn("doc_id", F.lit(None).cast("long")).select(*docs.columns)
    quality.train(copies, sample=50)
    langid.train(copies.withColumn("lang", F.lit("en")), sample=50)
