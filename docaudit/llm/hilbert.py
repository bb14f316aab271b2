"""Sharding by a Hilbert curve over metadata.

Language, source and size are quantised to a grid of 2**BITS cells a side.  The
cells' Hilbert indexes order the documents, so neighbours on the curve are alike
in all three dimensions, and equal cuts of that order give shards whose value
ranges prune files by any of them.

Only cells are ever ordered in one task: at most 2**(3 x BITS) of them.  Inside
a cell rows are ranked by seeded hash buckets, so a cell that holds a third of
all rows is split as well.  Law ``rows``: shard sizes differ by one row at most.

Defined results: a null text counts as empty (size 1, CRC of no bytes); null
metadata is a value of its own, before all others.  Rows that repeat an id are
rows of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import skew_safe_rank
from docaudit.session import cut_lineage

BITS = 4


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid points (one array of 0 to 2**bits - 1 for each dimension).

    The transform of J. Skilling (2004) on arrays: from the coarsest bit down
    the axes are reflected or swapped into the frame of the cell they lie in;
    the interleaved bits are then Gray-decoded.
    """
    x = [a.astype(np.int64).copy() for a in axes]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & (1 << level)) > 0, (1 << level) - 1, 0)
    x = [a ^ flip for a in x]
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | ((a >> level) & 1)
    return out


def _by_share(rows: DataFrame, col: str, levels: int) -> DataFrame:
    """(col, q_col): values in order, cut into ``levels`` ranges of about equal rows (one row a value is ordered)."""
    by = rows.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.col(col).asc_nulls_first())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mid = F.sum("_n").over(order) - F.col("_n") / 2
    return by.select(F.col(col).alias(f"_v_{col}"), F.least(F.floor(mid * levels / F.sum("_n").over(every)), F.lit(levels - 1)).cast("int").alias(f"q_{col}"))


def hilbert_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("lang", "source"), seed: int = 5) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve): every row in one of ``shards`` runs of the curve."""
    levels = 1 << BITS
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    metas = [F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(names)]
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), *metas), "shard-rows")
    # sizes by doubling ranges: a fixed grid, so no value has to be ordered
    cells = rows.withColumn("q_size", F.least(F.floor(F.log2("size")), F.lit(31)).cast("int"))
    lowest, highest = (lambda r: (r[0] or 0, r[1] or 0))(cells.agg(F.min("q_size"), F.max("q_size")).first())
    width = max(1, -(-(highest - lowest + 1) // levels))
    cells = cells.withColumn("q_size", F.floor((F.col("q_size") - lowest) / width).cast("int"))
    dims: list[str] = ["q_size"]
    for i in range(len(names)):
        of = _by_share(rows, f"m{i}", levels)
        cells = cells.join(of, F.col(f"m{i}").eqNullSafe(F.col(f"_v_m{i}"))).drop(f"_v_m{i}", f"m{i}")
        dims.append(f"q_m{i}")
    cells = cut_lineage(cells, "shard-cells")
    counts = cells.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("long")
    def curve(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([first.to_numpy(), *[r.to_numpy() for r in rest]], BITS))

    along = Window.orderBy("curve")
    starts = cut_lineage(counts.withColumn("curve", curve(*dims)).withColumn("start", F.sum("n").over(along) - F.col("n")), "curve")
    total = starts.agg(F.sum("n")).first()[0] or 0
    ranked = skew_safe_rank(cells, dims, ["id", "crc", "size"], "_rank", seed)
    placed = ranked.join(F.broadcast(starts.drop("n")), dims).withColumn("_at", F.col("start") + F.col("_rank"))

    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")  # integers: exact at any size
    return (
        placed.withColumn("shard", F.expr(f"cast((_at * {shards}) div {max(total, 1)}L as int)"))
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            "shard",
            (F.col("_at") - first).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )


def write_shards(df: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("lang", "source"), seed: int = 5) -> None:
    """Parquet files by shard, rows in curve order, so that each file's value ranges are narrow.

    Rows are placed by a number of their own, so rows without id and rows that
    share one are all written, once.  The folders are ``shard=<n>``; a column of
    ``df`` named ``shard`` is kept as ``shard_``.
    """
    own = df.withColumnRenamed("shard", "shard_").select(F.struct("*").alias("row"))
    rows = cut_lineage(own.withColumn("key", F.monotonically_increasing_id()), "shard-input")
    flat = rows.select("key", F.col("row")[text_col].alias("text"), *[F.col("row")[c].alias(f"n{i}") for i, c in enumerate(names)])
    placed = hilbert_shards(flat, shards, "key", "text", tuple(f"n{i}" for i in range(len(names))), seed).select("key", "shard", "slot")
    ordered = rows.join(placed, "key").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", "shard").write.partitionBy("shard").parquet(path)
