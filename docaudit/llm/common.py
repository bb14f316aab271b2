"""Helpers that several training-data operators share.

All of them are DataFrame to DataFrame.  Tables that more than one branch reads
are written once to the folder in ``spark.checkpoint.dir`` (``session.cut_lineage``),
which outlives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.session import cut_lineage

#: Word of a text: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def skew_safe_rank(df: DataFrame, group: list[str], order: list[str], out: str, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """0-based rank within ``group`` in a seeded order, without one task per group.

    Rows fall into ``buckets`` hash ranges of (seed, order columns); ranks are
    the rows before the bucket (sums over at most ``buckets`` counts a group)
    plus ``row_number`` inside it.  ``df`` is read twice, so hand in a written
    table.  Rows with equal order columns get ranks in any order: callers rank
    only rows that are alike in all that follows.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 64 - int(buckets).bit_length() + 1).cast("int"))
    keys = [*group, "_b"]
    before = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *order)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (
        rows.withColumn("_in", inside)
        .join(before, on)
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_h", "_b", "_in", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the edges (``u`` long, ``v`` long): rows (id, root).

    Alternating large-star and small-star rounds: every round hangs each node
    on the smallest node it sees, until every component is a star around its
    smallest id.  A round is joins and partial aggregates, so a node with very
    many neighbours is split by the skew join.  Each round is written once to
    the shared folder.  Ids that occur in no edge are not returned.
    """
    stars = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    was = _mark(stars)
    while was[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = _mark(stars)
        if now == was:
            break
        was = now
    leaves = stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaves.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """(rows, order-free sum of row hashes): equal for equal edge sets."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (a[i], b[i]) over nodes 0 to n - 1: at most n - 1 of them."""
    up = list(range(n))
    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((x, y))
    return kept


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal ``keys``, from batches sorted by them; at most one run is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and any(held[-1].column(k)[-1] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def by_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on every run of rows with equal ``keys``, sorted by ``order`` inside; one shuffle on the keys.

    Like a grouped map, but groups stream through one Arrow iterator per task,
    so many small groups cost no call into the JVM each.  The caller bounds the
    size of a group.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for run in runs(batches, keys):
            got = fn(run)
            if got is not None and got.num_rows:
                out.append(got)
                rows += got.num_rows
            if rows >= 5000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, how: str = "left") -> DataFrame:
    """Give every row the columns of its class; classes of very many rows are broadcast.

    ``size`` is the number of rows of a class.  Classes of more than a
    thousandth of all rows are at most a thousand, so that side is bounded
    whatever the data; all others take the shuffle join.  Both inputs are read
    more than once: hand in written tables.
    """
    most = classes.agg(F.sum(size)).first()[0] or 0
    hot = classes.where(F.col(size) * 1000 > F.lit(most))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes.where(F.col(size) * 1000 <= F.lit(most)), keys, how)
    return rows.join(F.broadcast(hot), keys).select(*rest.columns).unionByName(rest)


def block_pairs(df: DataFrame, blocks: str) -> DataFrame:
    """Rows of a group of ``blocks`` blocks, once for every pair of blocks (lo, hi) that holds their own; the block goes by column ``node``."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    return df.withColumn("blk", own).withColumn("_o", other).withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o")).drop("_o", blocks)


def sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a pair of blocks; the same rows twice for a block with itself."""
    blk, lo, hi = run["blk"].to_numpy(), run["lo"][0].as_py(), run["hi"][0].as_py()
    return np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
