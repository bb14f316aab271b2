import hashlib

from pyspark.sql import functions as F

from cases import awkward, empty, folded

from docaudit.llm.exact_dedup import directory, exact_dedup, keep_first_copies, keyed


def test_against_brute_force(spark):
    df = awkward(spark)
    groups = {}
    for r in df.collect():
        groups.setdefault(folded(r.text), []).append(r.doc_id)
    got = exact_dedup(df).collect()
    assert len(got) == df.count()
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            want.append((i, keep, len(ids), kept, sha))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup(empty(spark)).count() == 0


def test_buckets_split_until_they_fit(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 2500) AS text")
    keys = keyed(df, "doc_id", "text")
    slots, bits = directory(keys, capacity=100)
    rows = slots.collect()
    depths = {(r.bucket, r.depth) for r in rows}
    # every slot lies in one bucket, and no bucket is a prefix of another
    assert all((r.slot >> (bits - r.depth)) == r.bucket for r in rows)
    assert not any(d < e and (c >> (e - d)) == b for b, d in depths for c, e in depths)
    loads = {}
    for r in keys.select("h").distinct().collect():
        slot = (r.h & (2**64 - 1)) >> (64 - bits)
        row = next(x for x in rows if x.slot == slot)
        loads[row.bucket, row.depth] = loads.get((row.bucket, row.depth), 0) + 1
    assert max(loads.values()) <= 100 and len(loads) > 16
    got = exact_dedup(df, capacity=100)
    assert got.where("kept").count() == 2500 and got.where("group_size = 2").count() == 1000


def test_bytes_decide_where_hashes_meet(spark):
    df = awkward(spark)
    want = sorted(map(str, map(tuple, exact_dedup(df).collect())))
    one_hash = lambda norm: F.lit(7).cast("long")
    by_length = lambda norm: F.shiftleft(F.char_length(norm).cast("long"), 59)
    for hashed in (one_hash, by_length):
        assert sorted(map(str, map(tuple, exact_dedup(df, hashed=hashed, capacity=2).collect()))) == want


def test_directory_doubles_past_its_first_bits(spark):
    # the first hashes share four bits, so the six bits at the start cannot part them
    keys = spark.range(40).selectExpr("id", "shiftleft(id, 54) AS h").unionByName(spark.range(40, 50).selectExpr("id", "shiftleft(-id, 54) AS h"))
    slots, bits = directory(keys, capacity=8)
    rows = slots.collect()
    assert bits > 6 and sum(r.n_rows for r in rows) == 50
    loads = {}
    for r in rows:
        loads[r.depth, r.bucket] = loads.get((r.depth, r.bucket), 0) + r.n_rows
    assert max(loads.values()) <= 8
    number = lambda norm: F.shiftleft(F.substring(norm, 2, 9).cast("long"), 54)
    df = spark.range(120).selectExpr("id AS doc_id", "concat('t', id % 40) AS text")
    got = exact_dedup(df, capacity=8, hashed=number)
    assert got.where("kept").count() == 40 and got.where("group_size = 3 AND keep_id = 80 + doc_id % 40").count() == 120


def test_kept_rows_are_whole(spark):
    df = awkward(spark)
    kept = keep_first_copies(df, exact_dedup(df))
    assert kept.columns == df.columns
    texts = [folded(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({folded(r.text) for r in df.collect()})
