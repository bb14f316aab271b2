"""Running sums within a key that one task never has to hold as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def sum_before(df: DataFrame, key: str, place: str, order: tuple[str, ...], width: Column, out: str) -> DataFrame:
    """Sum of ``width`` over the rows of ``key`` that come before, in order of ``place`` (an integer), then ``order``.

    Rows fall into blocks of ``place``; a block is one window and gets the sums
    of the blocks before it.  A key with very many rows is spread over its
    blocks, and rows of block 0 need no join.
    """
    rows = df.withColumn("__blk", F.floor(F.col(place) / F.lit(BLOCK)).cast("long")).withColumn("__w", width.cast("long"))
    inside = Window.partitionBy(key, "__blk").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn(out, F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    blocks = rows.groupBy(key, "__blk").agg(F.sum("__w").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(key, "__blk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    first = within.filter(F.col("__blk") <= 0)
    later = within.filter(F.col("__blk") > 0).join(offsets.filter(F.col("__blk") > 0), [key, "__blk"])
    later = later.withColumn(out, F.col(out) + F.col("__off"))
    cols = [*df.columns, out]
    return first.select(*cols).unionByName(later.select(*cols))
