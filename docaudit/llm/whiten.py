"""Embedding whitening with distributed block matrices (Spark MLlib BlockMatrix).

1. An entry c becomes the long ``floor(1024 * c) + 100000``.  Sums and squared
   deviations are exact integers.
2. Rows are centred and numbered without a gap: the rows before a row's scan
   task (a count for each task) plus its place in that task.  Runs of ``height``
   rows are the blocks of a tall matrix.
3. The scatter matrix is the transpose times the matrix.  Its middle dimension
   is split over many tasks, so no task gets all blocks; what comes to the
   driver is one dims x dims matrix, decomposed there.
4. The same blocks, laid out as a square grid, are multiplied by a block
   diagonal of the whitening matrix.  A product's blocks are dealt in a grid, so
   a tall matrix would get only the square root of the tasks; the square layout
   gets all, and its empty blocks cost nothing.
5. The covariance of the whitened rows is taken from the result itself.

Defined results: a row whose vector is null or holds null or non-finite entries
is dropped; so is one with an entry beyond 2**40, whose long and sums no long
holds.  A null id stays, and rows that share an id are rows each.  Vectors of
different length are fitted apart, an empty vector has no component.  A
component without variance has ``explained`` 0 and a null ``whitened``, and takes
no part in ``identity_error``.  ``deviation`` is a decimal(38,0).  The sign of a
component makes its largest entry positive.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docaudit.session import cut_lineage

#: Entries of a block at most, rows of a block at least.
BLOCK, LEAST = 1 << 19, 128
#: Largest absolute entry.
LARGEST = float(1 << 40)
RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

_AT = pa.struct([("i", pa.int64()), ("j", pa.int64())])
_MATRIX = pa.struct(
    [("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())),
     ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]
)
_BLOCKS = StructType([StructField("at", StructType([StructField("i", LongType()), StructField("j", LongType())])), StructField("m", MatrixUDT())])


def _sound(vec: Column) -> Column:
    bad = F.exists(vec, lambda c: c.isNull() | c.isNaN() | (F.abs(c) > LARGEST))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _dense(values: pa.Array, rows: int, cols: int, by_row: bool) -> dict:
    return {"type": 1, "numRows": rows, "numCols": cols, "colPtrs": None, "rowIndices": None, "values": values, "isTransposed": by_row}


def block_matrix(blocks: DataFrame, height: int, cols: int, deal: int = 1) -> BlockMatrix:
    """Matrix of (block long, values array<double> by row): block b stands at row b // deal and column b % deal of the grid."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, values = batch.column(0)[k].as_py(), batch.column(1)[k].values
                full = pa.concat_arrays([values, pa.array(np.zeros(height * cols - len(values)))]) if len(values) < height * cols else values
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([{"i": at // deal, "j": at % deal}], _AT),
                        pa.StructArray.from_arrays(
                            [
                                pa.array([1], pa.int8()), pa.array([height], pa.int32()), pa.array([cols], pa.int32()), pa.nulls(1, pa.list_(pa.int32())),
                                pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays([0, height * cols], full), pa.array([True]),
                            ],
                            fields=list(_MATRIX),
                        ),
                    ],
                    ["at", "m"],
                )

    made = blocks.select("block", "values").mapInArrow(task, _BLOCKS)
    most = blocks.agg(F.max("block")).first()[0]
    wide = min(deal, most + 1)
    java = callMLlibFunc("createBlockMatrix", made, height, cols, (most // deal + 1) * height, wide * cols)
    return BlockMatrix(java, height, cols)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix, the middle dimension split over ``splits`` tasks; a local array."""
    flat = matrix.transpose()
    java = flat._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(spark: SparkSession, blocks: DataFrame, height: int, weights: np.ndarray) -> DataFrame:
    """(block long, values array<double> by row) of every block times ``weights``, by one multiplication of block matrices."""
    dims, k = weights.shape
    most = blocks.agg(F.max("block")).first()[0]
    deal = math.isqrt(most) + 1
    left = block_matrix(blocks, height, dims, deal)
    wide = min(deal, most + 1)
    flat = weights.reshape(-1).tolist()

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([{"i": i, "j": i}], _AT), pa.array([_dense(flat, dims, k, True)], _MATRIX)], ["at", "m"])

    right = callMLlibFunc("createBlockMatrix", spark.range(wide).mapInArrow(diagonal, _BLOCKS), dims, k, wide * dims, wide * k)
    product = left.multiply(BlockMatrix(right, dims, k))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, m = batch.column(0)[row].as_py(), batch.column(1)[row]
                values = np.asarray(m["values"].values).reshape((height, k), order="C" if m["isTransposed"].as_py() else "F")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at["_1"] * deal + at["_2"]], pa.int64()), pa.ListArray.from_arrays([0, height * k], pa.array(values.reshape(-1)))], ["block", "values"]
                )

    found = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    return found.mapInArrow(back, "block long, values array<double>").where(F.col("block") <= most)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``index``, 0-based without a gap.  ``row`` holds the task in its upper bits and the place in the task below."""
    task = F.shiftrightunsigned("row", 33)
    # one row for each task that wrote the table
    before = rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("c"))
    before = before.withColumn("before", F.sum("c").over(Window.orderBy("task")) - F.col("c")).select("task", "before")
    place = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("task", task).join(F.broadcast(before), "task").withColumn("index", F.col("before") + place).drop("task", "before", "row")


def _fit(rows: DataFrame, dims: int, n: int, most: int) -> DataFrame:
    spark = rows.sparkSession
    # dims exact sums
    sums = [int(r[1]) for r in rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)"))).orderBy("pos").collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    height = max(1, min(max(LEAST, -(-n // (4 * tasks))), BLOCK // dims or 1))
    total = F.array(*[F.lit(str(s)).cast("decimal(30,0)") for s in sums])
    apart = F.zip_with("x", total, lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(36,0)"))
    centred = _numbered(rows.select("id", "row", apart.alias("apart"))).select(
        F.floor(F.col("index") / height).cast("long").alias("block"),
        F.struct(
            F.col("index"),
            "id",
            F.aggregate("apart", F.lit(0).cast("decimal(38,0)"), lambda s, d: (s + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)"))).cast("decimal(38,0)")).alias("deviation"),
            F.transform("apart", lambda d: d.cast("double") / F.lit(float(n))).alias("values"),
        ).alias("r"),
    )
    grouped = centred.groupBy("block").agg(F.array_sort(F.collect_list("r")).alias("r"))  # at most ``height`` rows
    blocks = cut_lineage(grouped.select("block", F.col("r.id").alias("ids"), F.col("r.deviation").alias("deviations"), F.flatten("r.values").alias("values")), "whiten-blocks")
    splits = max(1, min(tasks, -(-n // height)))
    covariance = scatter(block_matrix(blocks, height, dims), splits) / n
    trace = float(np.trace(covariance))
    values, vectors = components((covariance + covariance.T) / 2, most)
    live = values > max(trace, 0.0) * dims * 2.0**-50
    k = len(values)
    weights = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    white = project(spark, blocks, height, weights).withColumnRenamed("values", "white")
    cut = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.slice("white", i * k + 1, k)).alias("white")  # without the last block's padding
    done = cut_lineage(white.join(blocks.select("block", "ids", "deviations"), "block").select("ids", "deviations", cut), "whitened")
    parts = done.select(F.explode("white").alias("w"))
    on = [j for j in range(k) if live[j]]
    error = 0.0
    if on:
        means = parts.agg(*[F.avg(F.col("w")[j]) for j in on]).first()
        pairs = [(a, b) for a in range(len(on)) for b in range(a + 1)]
        got = parts.agg(*[F.sum((F.col("w")[on[a]] - means[a]) * (F.col("w")[on[b]] - means[b])) / n for a, b in pairs]).first()
        error = max(abs(v - (a == b)) for v, (a, b) in zip(got, pairs))
    facts = [F.struct(F.lit(j + 1).alias("component"), F.lit(bool(live[j])).alias("live"), F.lit(float(values[j] / trace) if live[j] else 0.0).alias("explained")) for j in range(k)]
    row = F.explode(F.arrays_zip("ids", "deviations", "white")).alias("row")
    flat = done.select(row).select("row.*").select("ids", "deviations", F.explode(F.arrays_zip("white", F.array(*facts).alias("fact"))).alias("c"))
    return flat.select(
        F.col("ids").alias("id"), F.col("c.fact.component").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviations").alias("deviation"),
        F.when(F.col("c.fact.live"), F.col("c.white")).alias("whitened"), F.col("c.fact.explained").alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every sound row and up to ``most`` components: see the module text."""
    spark = df.sparkSession
    sound = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(_sound(F.col("vec")) & (F.size("vec") > 0))
    x = F.transform("vec", lambda c: F.floor(c * 1024) + F.lit(100_000).cast("long")).alias("x")
    rows = cut_lineage(sound.select("id", x).withColumn("row", F.monotonically_increasing_id()), "whiten-rows")
    # one row for each length of vector
    widths = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect()
    found = spark.createDataFrame([], f"id {df.schema[id_col].dataType.simpleString()}, {RESULT}")
    for r in widths:
        own = rows
        if len(widths) > 1:
            own = cut_lineage(rows.where(F.size("x") == r["dims"]).select("id", "x").withColumn("row", F.monotonically_increasing_id()), "whiten-width")
        part = _fit(own, r["dims"], r["n"], min(most, r["dims"]))
        found = part if len(widths) == 1 else found.unionByName(part)
    return found.withColumnRenamed("id", id_col)
