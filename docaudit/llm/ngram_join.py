"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Two documents are linked when the Jaccard similarity of their sets of 5-word
shingles is 0.8 or more.  Steps:

1. One pass over the texts gives each document its set's fingerprint and size
   and 128 MinHash values of 16 bits.  Documents with equal sets are one class
   from here on, with a weight, so copies never meet as pairs.
2. Bands of four values give candidate buckets.  Buckets with the same members
   are kept once.  A pair with similarity 0.8 misses all 32 bands with a
   probability of 5e-8.
3. Inside a bucket, pairs compare their MinHash values 16 at a time; a pair is
   dropped as soon as the posterior probability of similarity >= threshold
   (uniform prior) is below ``tolerance``.  Only a spanning forest of the
   surviving pairs leaves the task: at most one row a member.
4. The candidate groups that the forests connect are verified: members meet
   blockwise, pairs are pruned the same way again and the rest compared on
   their whole shingle sets.  What leaves the task is a link count for each
   member and a spanning forest of the true links.

Large buckets and groups are cut into blocks whose pairs of blocks are separate
tasks; no step puts a whole group in one task or writes all its pairs.

Defined results: words are runs of non-blanks, A-Z lower-cased.  A text of one
to four words is one shingle.  Null, empty and blank texts have no shingles and
link with nothing.  A row without id links with nothing (class null).  Copies
and repeated rows count as links of each other; rows that share an id share a
class.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import block_pairs, by_runs, components, forest, join_classes, sides
from docaudit.llm.textvec import mix, shingles, word_chunks
from docaudit.session import cut_lineage

PERMS, ROWS, STEP = 128, 4, 16
BANDS = PERMS // ROWS
#: Members of a bucket, or of a group, that one side of a task holds; shingles for a group.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**32, PERMS, dtype=np.uint32)[:, None]
_ODD = (_RNG.integers(0, 2**31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SET = _RNG.integers(1, 2**63, 2, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)


def minhash(grams: np.ndarray) -> np.ndarray:
    """128 MinHash values of a set of 64-bit hashes, each cut to 16 mixed bits."""
    x = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 2048):
        h = (x[:, at : at + 2048] ^ _XOR) * _ODD
        h ^= h >> np.uint32(15)
        np.minimum(low, h.min(axis=1), out=low)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    low = (low ^ (low >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (low >> np.uint32(16)).astype("<u2")


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set of hashes, as two signed integers."""
    return tuple(int(mix(grams ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in _SET)


def needed(threshold: float, tolerance: float) -> list[int]:
    """Matches that a pair needs after each step to stay: with a uniform prior,
    P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, PERMS + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of a, row of b) that incremental comparison keeps; tiles bound the memory."""
    left, right = [], []
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 256):
            x, y = np.divmod(np.arange(len(a[i : i + 256]) * len(b[j : j + 256])), len(b[j : j + 256]))
            x, y = x + i, y + j
            same = np.zeros(len(x), np.int32)
            for k, least in enumerate(need):
                part = slice(k * STEP, (k + 1) * STEP)
                same += (a[x, part] == b[y, part]).sum(axis=1, dtype=np.int32)
                on = same >= least
                if not on.all():
                    x, y, same = x[on], y[on], same[on]
                if not len(x):
                    break
            left.append(x)
            right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, words, at in word_chunks(batch.column(1)):
            grams, at = shingles(words, at)
            out = [(0, 0, 0, None)] * n
            for r in np.flatnonzero(np.diff(at)):
                own = np.unique(grams[at[r] : at[r + 1]])
                out[r] = (*fingerprint(own), len(own), minhash(own).tobytes())
            h1, h2, size, sig = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())],
                ["id", "h1", "h2", "n_shingles", "sig"],
            )


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PERMS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = mix(mix(_signatures(part.column(1)).view("<u8") ^ _BAND[None, :]))
            node = np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.ravel().view(np.int64))], ["node", "key"])


def _pairs(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    x, y = surviving(sig[a], sig[b], need)
    x, y = a[x], b[y]
    if len(a) and len(b) and a[0] == b[0]:  # a block with itself: each pair once
        once = x < y
        x, y = x[once], y[once]
    return x, y


def _bucket(need: list[int]):
    def task(run: pa.Table) -> pa.RecordBatch | None:
        node, (a, b) = run["node"].to_numpy(), sides(run)
        if len(run) < 2:
            return None
        x, y = _pairs(_signatures(run["sig"]), a, b, need)
        kept = forest(len(run), x, y)
        return pa.RecordBatch.from_arrays([pa.array(node[[p for p, _ in kept]] if kept else [], pa.int64()), pa.array(node[[q for _, q in kept]] if kept else [], pa.int64())], ["u", "v"])

    return task


def common_sizes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets x[i] and y[i]."""
    if len(x) < 64:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist())], np.int64)
    used = np.unique(np.concatenate([x, y]))
    rows = np.repeat(used, [len(sets[i]) for i in used])
    grams, col = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    # shingles of one member alone are in no intersection
    shared = np.flatnonzero(np.bincount(col) > 1)
    to = np.full(len(grams), -1, np.int64)
    to[shared] = np.arange(len(shared))
    col = to[col]
    rows, col = rows[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    place = np.zeros(max(a.max(), b.max()) + 1, np.int64)
    total = np.zeros((len(a), len(b)), np.float32)
    in_a, in_b = np.isin(rows, a), np.isin(rows, b)
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(col, [at, at + 4096])
        width = min(4096, len(shared) - at)
        both = []
        for members, inside in ((a, in_a), (b, in_b)):
            place[members] = np.arange(len(members))
            pick = inside[lo:hi]
            m = np.zeros((len(members), width), np.float32)
            m[place[rows[lo:hi][pick]], col[lo:hi][pick] - at] = 1
            both.append(m)
        total += both[0] @ both[1].T  # counts below 2**24 are exact
    place_a, place_b = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    return total[place_a[x], place_b[y]].astype(np.int64)


def _verify(need: list[int], threshold: float):
    def task(run: pa.Table) -> pa.RecordBatch | None:
        h1, h2 = run["h1"].to_numpy(), run["h2"].to_numpy()
        seen: dict[tuple[int, int], int] = {}
        for i, key in enumerate(zip(h1.tolist(), h2.tolist())):
            seen.setdefault(key, i)  # a repeated row of one class
        if len(seen) < len(run):
            run = run.take(pa.array(sorted(seen.values()), pa.int64()))
            h1, h2 = run["h1"].to_numpy(), run["h2"].to_numpy()
        node, weight = run["node"].to_numpy(), run["weight"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in run["grams"].to_pylist()]
        a, b = sides(run)
        if not len(a) or not len(b):
            return None
        sig = _signatures(run["sig"])
        size = np.array([len(s) for s in sets], np.int64)
        links, tied = np.zeros(len(run), np.int64), []
        whole = a[0] == b[0]
        for i in range(0, len(a), 512):
            for j in range(i if whole else 0, len(b), 512):
                x, y = _pairs(sig, a[i : i + 512], b[j : j + 512], need)
                if not len(x):
                    continue
                both = common_sizes(sets, a[i : i + 512], b[j : j + 512], x, y)
                joined = size[x] + size[y] - both
                on = both >= np.ceil(threshold * joined - 1e-9)
                x, y = x[on], y[on]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                tied += forest(len(run), x, y)
        tied = forest(len(run), np.array([p for p, _ in tied], np.int64), np.array([q for _, q in tied], np.int64))
        rows = np.flatnonzero(links)
        pad = [None] * len(tied)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*h1[rows].tolist(), *pad], pa.int64()),
                pa.array([*h2[rows].tolist(), *pad], pa.int64()),
                pa.array([*links[rows].tolist(), *pad], pa.int64()),
                pa.array([*[None] * len(rows), *[int(node[p]) for p, _ in tied]], pa.int64()),
                pa.array([*[None] * len(rows), *[int(node[q]) for _, q in tied]], pa.int64()),
            ],
            ["h1", "h2", "links", "u", "v"],
        )

    return task


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of fetched texts; a row whose text is not its class's (a repeated id) goes."""
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        for first, n, words, at in word_chunks(batch.column("text")):
            grams, at = shingles(words, at)
            sets, rows = [], []
            for r in range(n):
                own = np.unique(grams[at[r] : at[r + 1]])
                if len(own) and fingerprint(own) == (h1[first + r], h2[first + r]):
                    sets.append(own.tobytes())
                    rows.append(first + r)
            part = batch.take(pa.array(rows, pa.int64()))
            names = ["root", "node", "h1", "h2", "weight", "blocks", "sig"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sets, pa.large_binary())], [*names, "grams"])


def ngram_join(df: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_shingles) for every row: see the module text.

    ``class_id`` is the smallest id that links reach from the row, ``n_links``
    the number of other rows that it is linked with directly.
    """
    need = needed(threshold, tolerance)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = cut_lineage(texts.mapInArrow(_sketch, "id long, h1 long, h2 long, n_shingles long, sig binary"), "sketches")
    classes = cut_lineage(
        sketches.where("id is not null and n_shingles > 0")
        .groupBy("h1", "h2", "n_shingles", "sig")
        .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")),
        "classes",
    )
    bands = classes.select("node", "sig").mapInArrow(_bands, "node long, key long")
    buckets = (
        bands.groupBy("key")
        .agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        .where("m > 1")
        .groupBy("m", "x", "lo", "hi")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    )
    members = cut_lineage(bands.join(buckets, "key"), "members").join(classes.select("node", "sig"), "node")
    tied = by_runs(block_pairs(members, "blocks"), ["key", "lo", "hi"], [], _bucket(need), "u long, v long")
    groups = components(tied, "candidates")

    wanted = groups.join(classes, groups.id == classes.node).select("root", "node", "h1", "h2", "n_shingles", "weight", "sig")
    parts = wanted.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    wanted = wanted.drop("n_shingles").join(parts, "root")
    fetched = texts.join(wanted, texts.id == wanted.node).select("root", "node", "h1", "h2", "weight", "blocks", "sig", "text")
    sets = fetched.mapInArrow(_grams, "root long, node long, h1 long, h2 long, weight long, blocks long, sig binary, grams binary")
    found = cut_lineage(
        by_runs(block_pairs(sets, "blocks"), ["root", "lo", "hi"], ["node"], _verify(need, threshold), "h1 long, h2 long, links long, u long, v long"),
        "links",
    )
    roots = components(found.where("u is not null").select("u", "v"), "classes").withColumnRenamed("id", "node")
    counts = found.where("links is not null").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    facts = cut_lineage(
        classes.select("h1", "h2", "node", "weight")
        .join(counts, ["h1", "h2"], "left")
        .join(roots, "node", "left")
        .select("h1", "h2", "weight", F.coalesce("root", "node").alias("class"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")),
        "class-facts",
    )
    rows = join_classes(sketches.select("id", "h1", "h2", "n_shingles"), facts, ["h1", "h2"], "weight")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    return rows.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        "n_shingles",
    )
