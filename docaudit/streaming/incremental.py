"""Incremental batch: the batch job run over newly arrived files.

``readStream.format("binaryFile")`` picks up new files in a folder; each
micro-batch is loaded, and with stored answers also extracted and validated,
exactly like a batch run.  ``trigger(availableNow=True)`` processes what has
arrived and stops; the checkpoint records which files are done.  A micro-batch
may be given out twice after a failure, so each epoch overwrites its own folder
``epoch=<n>``: a retried one leaves no second copy.

**Files that wait for a decoder.**  PDF, CSV and workbook files need pages or
cells, which decoders may write later (or earlier).  A decoder writes the rows of
some files as Parquet and then, for each file, a JSON line ``file, pages, cells``
(the folder of its rows, null for the table that it does not make) into
``decoded``.  A stream-stream left join on the path holds a routed file (its row,
not its bytes) until that line comes, or until ``wait`` has passed, when it
becomes an input error.  Time is the time of the micro-batch, which a retried
one keeps.  Every run writes a tick into its checkpoint, so time passes even
when nothing arrives.  An epoch reads only the folders that its own lines name.
A file's first line counts; a line more than ``KEPT`` ahead of its file is lost.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.config import DEFAULT_LIMITS, Limits
from docaudit.plans.jobs import DECODED, load_routed, routed_files, run_batch, run_loaded, without_decoder
from docaudit.session import cut_lineage, ensure_checkpoint_dir
from docaudit.sources.files import SUPPORTED_EXTENSIONS, route, suffix_of, text_guard

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


DECODED_SCHEMA = "file string, pages string, cells string"
#: How long a decoder's line waits for its file.
KEPT = "30 days"
TIMED_OUT = "Input was not decoded in time"


def load_stage(files: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Routing + guards for one batch of files (no content kept in the output)."""
    supported = files.filter(suffix_of(F.col("path")).isin(*SUPPORTED_EXTENSIONS))
    g = text_guard(route(supported, "path", limits))
    return g.select("path", "file_name", "route", "media_type", "sha256", "byte_count", "error_code", "error")


def run_incremental(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    responses: DataFrame | None = None,
    decoded: str | None = None,
    wait: str = "1 day",
):
    """Process the files that arrived since the last run; returns the finished query.

    Without ``responses`` an epoch holds the load outcomes; with them
    ``out_dir/outcomes`` and ``out_dir/envelopes`` hold the batch run's tables.
    With ``decoded`` files wait for their decoder's line up to ``wait``; without
    it files that need a decoder are input errors.  The default checkpoint is
    named after the two folders.
    """
    name = hashlib.sha256(f"{in_dir}\n{out_dir}".encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    stream = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "false")
        .load(in_dir)
    )
    if decoded is not None:
        if responses is None:
            raise ValueError("waiting for decoders needs responses")
        # both streams carry the micro-batch's time: the later one is now
        spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
        _tick(spark, ckpt)
        stream = waiting(spark, stream, decoded, f"{ckpt}-ticks", limits, wait)
        write = lambda batch, epoch: write_decoded_epoch(batch, epoch, out_dir, limits, responses)
    else:
        write = lambda batch, epoch: write_epoch(batch, epoch, out_dir, limits, responses)
    q = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def write_epoch(batch: DataFrame, epoch: int, out_dir: str, limits: Limits = DEFAULT_LIMITS, responses: DataFrame | None = None) -> None:
    """Write one micro-batch to its own folder; writing it again replaces it."""
    if responses is None:
        tables = {out_dir: load_stage(batch, limits)}
    else:
        run = run_batch(_supported(batch), responses, limits=limits)
        tables = {f"{out_dir}/outcomes": run.outcomes, f"{out_dir}/envelopes": run.envelopes}
    for path, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _supported(files: DataFrame) -> DataFrame:
    return files.filter(suffix_of(F.col("path")).isin(*SUPPORTED_EXTENSIONS))


def _tick(spark: SparkSession, ckpt: str) -> None:
    spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run")).write.mode("append").json(f"{ckpt}-ticks")


def waiting(spark: SparkSession, files: DataFrame, decoded: str, ticks: str, limits: Limits, wait: str) -> DataFrame:
    """Stream of routed files with ``pages``, ``cells`` and ``timed_out``: at once where no decoder is needed, else with its line or after ``wait``."""
    kinds = [k for group in DECODED.values() for k in group]
    routed = routed_files(_supported(files), limits)
    needs = F.col("error").isNull() & F.col("route").isin(*kinds)
    none = F.lit(None).cast("string")
    direct = routed.where(~needs).withColumns({"pages": none, "cells": none, "timed_out": F.lit(False)})
    lines = spark.readStream.schema(DECODED_SCHEMA).json(decoded).select("file", "pages", "cells")
    beats = spark.readStream.schema("run string").json(ticks).select(F.concat(F.lit("tick:"), "run").alias("file"), none.alias("pages"), none.alias("cells"))
    # what the state keeps is never null, so its schema is the same whichever source has new rows
    text = lambda row: F.coalesce(F.to_json(row), F.lit(""))
    key = lambda c: F.coalesce(F.col(c), F.lit(""))
    came = lines.unionByName(beats).select(key("file").alias("file"), text(F.struct("pages", "cells")).alias("line"), F.current_timestamp().alias("came"))
    held = routed.where(needs).select(key("doc_key").alias("path"), text(F.struct(*routed.columns)).alias("row"), F.current_timestamp().alias("seen"))
    on = (F.col("path") == F.col("file")) & (F.col("came") >= F.col("seen") - F.expr(f"INTERVAL {KEPT}")) & (F.col("came") <= F.col("seen") + F.expr(f"INTERVAL {wait}"))
    met = held.withWatermark("seen", "0 seconds").join(came.withWatermark("came", "0 seconds"), on, "left")
    back = met.select(
        F.from_json("row", routed.schema).alias("r"), F.from_json("line", "pages string, cells string").alias("l"), F.col("file").isNull().alias("timed_out")
    )
    return direct.unionByName(back.select("r.*", "l.pages", "l.cells", "timed_out"))


def write_decoded_epoch(batch: DataFrame, epoch: int, out_dir: str, limits: Limits, responses: DataFrame) -> None:
    """The batch run over the files that are ready in this epoch, with the decoder rows that their lines name."""
    spark = batch.sparkSession
    ready = cut_lineage(batch.dropDuplicates(["doc_key"]), "ready")
    if ready.isEmpty():  # time passed, no more; a retried epoch has the same rows
        return
    tables: dict[str, DataFrame | None] = {}
    for table, kinds in DECODED.items():
        # one row for each folder that a line of this epoch names
        folders = [r[0] for r in ready.where(F.col(table).isNotNull()).select(table).distinct().collect()]
        tables[table] = spark.read.parquet(*folders) if folders else None
    routed = without_decoder(ready.where("timed_out"), tuple(k for g in DECODED.values() for k in g), TIMED_OUT).unionByName(ready.where("not timed_out"))
    run = run_loaded(load_routed(routed.drop("pages", "cells", "timed_out"), limits, tables["pages"], tables["cells"]), responses)
    for path, df in {f"{out_dir}/outcomes": run.outcomes, f"{out_dir}/envelopes": run.envelopes}.items():
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
