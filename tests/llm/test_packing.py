import random

import numpy as np
import public_tokenizers

from docaudit.llm.bpe import PrefixBPE
from docaudit.llm.packing import best_fit_decreasing, pack_tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def plain_best_fit(lengths, length):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(length - size)
    return sorted(rooms)


def test_segment_tree_packs_as_plain_best_fit_does():
    random.seed(2)
    for _ in range(300):
        length = random.choice([1, 5, 8, 16, 31, 64])
        sizes = [random.randint(1, length) for _ in range(random.randint(0, 60))]
        got = best_fit_decreasing(sizes, length)
        assert sorted(i for g in got for i in g) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in g) for g in got) == plain_best_fit(sizes, length)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9000), (None, "no id")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    rows = pack_tokens(every, PATH, length=256, block_tokens=20_000).collect()
    bpe = PrefixBPE(PATH)
    want = {r["doc_id"]: np.frombuffer(bpe.encode(r["text"] or ""), "<u4").tolist() for r in every.collect()}
    parts = {}
    assert len({r["row_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, at, cu = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(at) == 256 and cu[-1] == r["n_tokens"] <= 256 and (ids[cu[-1] :] == 49407).all()
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            parts.setdefault(doc, []).append((start, ids[cu[k] : cu[k + 1]].tolist()))
            assert at[cu[k] : cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
    back = {d: sum((p for _, p in sorted(v)), []) for d, v in parts.items()}
    assert back == {d: v for d, v in want.items() if v}
    full = sum(len(v) for v in want.values()) / 256
    assert len(rows) < full * 1.05 + 8
    assert pack_tokens(every.limit(0), PATH).count() == 0
