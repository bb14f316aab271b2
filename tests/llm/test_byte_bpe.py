import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from cases import awkward, empty

from docaudit.llm import byte_bpe
from docaudit.llm.byte_bpe import MergeReplay, byte_bpe_digest, byte_bpe_encode

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
SIGNS = "abcdefghijklmnopqrstuvwxyzABCΣσςİßéÉñ0123²½'’!?.,-_#$€ \u0085 \x1c\x1f​\t\n\r　日本語한국어हिन्दीе́🙂👍🏽ǅﬁ́̇ªº\U00010ee7\U00011de3"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(mine, theirs, text):
    want = theirs.encode_ordinary(text)
    got = mine.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, text[:200]
    assert mine.decode(got) == text.encode("utf-8")


def test_ids_equal_the_library(spark):
    theirs, mine = library(), MergeReplay(PATH, PATTERN)
    rng = random.Random(13)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("theanigor ") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["", " ", "   a  b   ", "it's they'll 'S 'D we're", "a" * 5000, "ab" * 3000, "<|endoftext|>x", "\n\n\n x\n", "日本" * 900]
    for text in texts:
        same(mine, theirs, text)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        same(mine, theirs, r.text)


def test_one_corpus_equals_word_by_word():
    """Merges replayed over many words at once give what the library gives for each alone."""
    theirs, mine = library(), MergeReplay(PATH, PATTERN)
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu éü日") for _ in range(rng.randrange(1, 40))).encode() for _ in range(4000)] + [b"the" * 200, b"\xff\xfe", b"a"]
    got = mine.replay(words)
    assert len(got) == len(words) and mine.replay([]) == []
    for word, ids in zip(words, got):
        want = theirs._core_bpe.encode_single_piece(word)
        assert word in mine.ranks or ids.tolist() == want, word


def test_a_lower_rank_that_a_merge_brings_goes_first(tmp_path):
    """Ranks that no training order gives: a merge makes a pair of lower rank, which is next at once."""
    order = [bytes([b]) for b in range(256)]
    order += [b"abc", b"ab", b"cab", b"abcab", b"bca"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(order)))
    theirs = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
    mine = MergeReplay(str(path), PATTERN)
    rng = random.Random(5)
    for text in ["abcab" * 3, "cabcab", "abab"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 25))) for _ in range(500)]:
        same(mine, theirs, text)


def test_classes_of_all_code_points():
    """A letter or digit joins the sign after it in one word where the library joins them."""
    ranks = {bytes([b]): b for b in range(256)}
    for last in range(128, 192):
        for sign in (b"a", b"1", b","):
            ranks[bytes([last]) + sign] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = byte_bpe.Splitter(PATTERN)
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    for sign in "a1,":
        text = "".join(chr(c) + sign + "\n" for c in points)
        ids = np.array(probe.encode_ordinary(text))
        joined = ids[np.flatnonzero(ids == ord("\n")) - 1] >= 256
        words = {w for part in split.windows(text) for w in part}
        assert len(joined) == len(points)
        wrong = [c for c, one in zip(points, joined) if one != (chr(c) + sign in words)]
        assert not wrong, [hex(c) for c in wrong[:10]]


def test_windows_and_small_caches_change_nothing(monkeypatch):
    theirs = library()
    monkeypatch.setattr(byte_bpe, "WINDOW", 7)
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    mine = MergeReplay(PATH, PATTERN)
    rng = random.Random(2)
    for text in ["the quick, brown fox;  jumps over\n\nthirteen   lazy dogs! " * 3, "nations " * 9, "x" * 50] + ["".join(rng.choice(SIGNS) for _ in range(200)) for _ in range(300)]:
        same(mine, theirs, text)


def test_awkward_rows(spark):
    df, theirs = awkward(spark), library()
    want = [(r.doc_id, theirs.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in df.collect()]
    rows = byte_bpe_encode(df, PATH, PATTERN).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded))) for r in rows)
    digests = sorted(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())) for i, ids, raw in want)
    assert digests == sorted(str(tuple(r)) for r in byte_bpe_digest(df, PATH, PATTERN).collect())
    assert byte_bpe_digest(empty(spark), PATH, PATTERN).count() == 0


def test_long_ids_are_digested_in_parts():
    ids = np.arange(600_000, dtype="<u4")
    assert byte_bpe._decimal_digest(ids.tobytes(), [str(i) for i in range(600_000)]) == hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
