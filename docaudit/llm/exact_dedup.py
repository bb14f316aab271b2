"""Exact deduplication over an extendible-hash index on shared files.

DataFrame and SQL functions only.

1. Every row's (id, 64-bit hash of the normalised text) is written once; the
   normalised text has A-Z lower-cased, nothing else.
2. The directory starts near the depth that the row count asks for.  While a
   bucket (a prefix of the hash) holds more hashes than its capacity, it is
   split by one more bit, and the directory doubles when no bit is left.
3. Index entries are the distinct texts: copies are brought together by whole
   texts, so bytes decide, and collapse in the scan tasks first, so a text that
   a third of all rows hold sends one row a task.  The directory sends an entry
   to its bucket, and a bucket's owner task chains the entries of one hash.
4. Rows go to their bucket through the directory and take the entry of their
   hash there.  Where a chain has more than one link the hash is not enough:
   those rows' texts are read again and compared byte by byte with the links.
   Very large groups and slots are broadcast (at most a thousand), the others
   joined.

Defined results: a null text is an empty one.  The largest id of a group stays;
a row without id stays only in a group that has no id at all.  Of rows that
repeat both id and text exactly one is kept.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import join_classes
from docaudit.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of a bucket before it is split.
CAPACITY = 1 << 16


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keyed(df: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, norm, h) of every row."""
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return rows.withColumn("h", hashed(F.col("norm")))


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of the hash."""
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """((slot, depth, bucket, n_rows), global bits): the local depth and bucket of each directory slot, and the keys that meet in it.

    ``slot`` is a hash prefix of all global bits.  They are four more than
    evenly filled buckets would need; when an overfull bucket has used them all,
    the directory doubles and its slots are counted anew with one bit more.
    Only whether a bucket is overfull comes to the driver.
    """
    hashes = cut_lineage(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows")), "hashes")
    rows = keys.count()
    even = max(0, int(log2(max(rows, 1) / capacity))) if rows > capacity else 0
    bits = even + 4
    counted = lambda: hashes.groupBy(_prefix(bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"))
    at = cut_lineage(counted().withColumn("depth", F.lit(max(0, even - 1))), "directory")
    load = F.sum("n").over(Window.partitionBy("depth", "bucket"))
    while True:
        bucket = F.expr(f"shiftrightunsigned(slot, {bits} - depth)")
        filled = at.withColumn("bucket", bucket).withColumn("load", load)
        over = F.col("load") > capacity
        if filled.where(over).isEmpty():
            return filled.select("slot", "depth", "bucket", "n_rows"), bits
        if not filled.where(over & (F.col("depth") == bits)).isEmpty():
            bits += 1
            halves = counted().withColumn("parent", F.shiftrightunsigned("slot", 1))
            at = cut_lineage(halves.join(at.select(F.col("slot").alias("parent"), "depth"), "parent").drop("parent"), "directory")
        else:
            at = cut_lineage(filled.withColumn("depth", F.col("depth") + over.cast("int")).select("slot", "n", "n_rows", "depth"), "directory")


def _texts(rows: DataFrame) -> DataFrame:
    """Distinct texts of keyed rows, told apart by their bytes: (h, norm, keep_id, group_size)."""
    return rows.groupBy("h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """Index entries (depth, bucket, h, chain, links, sha, keep_id, group_size), one for each distinct text, on shared files.

    ``rows`` are of ``keyed``, ``slots`` of ``directory``.  ``links`` is the
    length of the chain that an entry stands in, ``chain`` its place.
    """
    entries = _texts(rows).select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size", _prefix(bits).alias("slot"))
    owned = entries.join(slots.drop("n_rows"), "slot").drop("slot").repartition("depth", "bucket")
    hash_of = Window.partitionBy("depth", "bucket", "h")
    linked = owned.withColumn("chain", F.row_number().over(hash_of.orderBy("sha")) - 1).withColumn("links", F.count(F.lit(1)).over(hash_of))
    return cut_lineage(linked, "hash-index")


def _chained(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(id, same, keep_id, group_size, sha) of the rows whose hash has a chain of several links, found by comparing whole texts."""
    several = index.where("links > 1").select("h").distinct()
    own = cut_lineage(rows.join(several, "h", "left_semi"), "chained-rows")
    links = cut_lineage(_texts(own).withColumn("sha", F.sha2("norm", 256)), "chain-links")
    same = cut_lineage(own.groupBy("id", "h", "norm").agg(F.count(F.lit(1)).alias("same")), "chained-keys")
    return join_classes(same, links, ["h", "norm"], "group_size", "inner").select("id", "same", "keep_id", "group_size", "sha")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too."""
    rows = keyed(df, id_col, text_col, hashed)
    keys = cut_lineage(rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("same")), "text-keys")
    slots, bits = directory(keys, capacity)
    slots = cut_lineage(slots, "slots")
    index = build_index(rows, slots, bits)
    routed = cut_lineage(join_classes(keys.withColumn("slot", _prefix(bits)), slots, ["slot"], "n_rows", "inner").drop("slot", "n_rows"), "routed-keys")
    alone = index.where("links = 1").drop("chain", "links")
    found = join_classes(routed, alone, ["depth", "bucket", "h"], "group_size", "inner").select("id", "same", "keep_id", "group_size", "sha")
    if not index.where("links > 1").isEmpty():
        found = found.unionByName(_chained(rows, index))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))).alias("copy")
    return found.select("id", "keep_id", "group_size", "sha", copy).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first_copies(df: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that ``decided`` (of ``exact_dedup``) keeps, one for each group, its columns unchanged."""
    kept = decided.where("kept").select(F.col(id_col).alias("__dd_id"), F.col("text_sha256").alias("__dd_sha"))
    rows = df.withColumn("__dd_own", F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col("__dd_id")) & (F.col("__dd_own") == F.col("__dd_sha"))
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "__dd_own"]).select(*df.columns)
