import random

import numpy as np
import public_tokenizers
from cases import awkward, empty
from tokenizers import Tokenizer

from docaudit.llm import bpe
from docaudit.llm.bpe import PrefixBPE, bpe_digest, bpe_encode

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def same(mine, theirs, text):
    want = theirs.encode(text, add_special_tokens=False).ids
    got = mine.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, text
    assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False), text


def test_ids_equal_the_library(spark):
    theirs, mine = Tokenizer.from_file(PATH), PrefixBPE(PATH)
    rng = random.Random(6)
    signs = "abcdefghijklmnopqrstuvwxyzABCΣσςİßéÉñ0123²½'’!?.,-_#$€ \u0085 \x1c\x1f​\t\n\r　日本語한국어हिन्दीе́🙂👍🏽ǅﬁ́̇ªº"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("theanigor") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>a<|startoftext|> B", "it's they'll 'S 'D we're", "a" * 5000, "ab " * 3, "x<|endoftext|"]
    for text in texts:
        same(mine, theirs, text)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        same(mine, theirs, r.text)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    theirs, mine = Tokenizer.from_file(PATH), PrefixBPE(PATH)
    for text in ("the quick, brown fox; jumps over thirteen lazy dogs! " * 3, "ations nation nations"):
        same(mine, theirs, text)


def test_awkward_rows(spark):
    df = awkward(spark)
    theirs = Tokenizer.from_file(PATH)
    rows = bpe_encode(df, PATH).collect()
    want = sorted(str((r.doc_id, theirs.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    assert sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert bpe_digest(df, PATH).count() == df.count() and bpe_digest(empty(spark), PATH).count() == 0
