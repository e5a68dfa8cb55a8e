"""Whitening of vectors with distributed block matrices.

Valid rows are scaled to integers, so counts and sums are exact, and numbered without gaps (a count a partition). Centred
rows become an IndexedRowMatrix and from it a BlockMatrix. Its transpose times itself is the scatter matrix;
the row blocks are dealt over many tasks there, each of which adds up its own products, so no task holds the table. The
eigenvectors of that small square matrix are found on the driver; the whitening matrix is one block a column
range, and the BlockMatrix times it gives the coordinates of all rows. Everything but the eigenvectors stays in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.session import durable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of a block, and rows of one at most: 8 MB.
BLOCK_ENTRIES, BLOCK_ROWS, BLOCK_COLUMNS = 1 << 20, 1 << 14, 1 << 10
#: Row blocks that a task multiplies.
BLOCKS_A_TASK = 8
#: Part of the largest eigenvalue below which a component has no variance.
NOTHING = 1e-12


def valid(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * scale) + shift).cast("long"))


def indexed(rows: DataFrame) -> DataFrame:
    """Adds ``index``: 0, 1, 2 and so on, by one count a partition. ``rows`` must be checkpointed."""
    held = rows.withColumn("_m", F.monotonically_increasing_id())
    counts = sorted(held.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())
    starts = np.cumsum([0, *[n for _, n in counts]])
    offsets = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts, strict=False)], "p long, start long")
    return held.join(F.broadcast(offsets), F.shiftright("_m", 33) == F.col("p")).withColumn(
        "index", F.col("start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "p", "start")


def blocks(rows: DataFrame, column: str, n: int, dimension: int) -> BlockMatrix:
    """The vectors of an indexed table as a matrix of n rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(F.col(column)).alias("vector")), "vector")
    width = min(dimension, BLOCK_COLUMNS)
    height = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // width))
    return IndexedRowMatrix(vectors, n, dimension).toBlockMatrix(height, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix; row blocks are dealt over tasks and added up."""
    split = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    own = matrix.transpose()
    product = own._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, split)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def product(matrix: BlockMatrix, other: np.ndarray, spark: SparkSession) -> DataFrame:
    """(index, values) of the matrix times a small one."""
    rows = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(other)], ["index", "vector"])
    small = IndexedRowMatrix(rows, *other.shape).toBlockMatrix(matrix.colsPerBlock, min(other.shape[1], BLOCK_COLUMNS))
    found = callMLlibFunc("getIndexedRows", matrix.multiply(small).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("values"))


def eigen(variance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    return values[::-1][:count], vectors[:, ::-1][:, :count]


def means(rows: DataFrame, column: str) -> list:
    """Sums by place in an array, in order; partial sums travel, a row a place."""
    found = rows.select(F.posexplode(column).alias("place", "value")).groupBy("place").agg(F.sum("value").alias("s"))
    return [r.s for r in sorted(found.collect())]


def covariance(rows: DataFrame, column: str, n: int, mean: list[float]) -> np.ndarray:
    """Of an indexed table's arrays, divisor n, each centred first."""
    centred = rows.select("index", F.zip_with(column, F.lit(mean), lambda v, m: v - m).alias("c"))
    return scatter(blocks(centred, "c", n, len(mean))) / n


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each valid vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries count as long x = floor(scale * c) + shift. Null and empty vectors, and those with a null or
    non-finite entry, are left out, as are vectors of another length than most (the shorter of two equally frequent
    ones is kept). n vectors remain, S are their sums; ``deviation`` is the sum of (n * x - S) ** 2, exact (decimal).
    ``whitened`` is x - S / n projected on a unit eigenvector of the covariance and divided by the root of its
    eigenvalue; components are numbered by falling eigenvalue, at most ``components``. ``explained`` is the eigenvalue's
    part of the variance, ``identity_error`` how far the covariance of ``whitened`` is from the identity at most. A
    component without variance (constant or too few vectors) has a null ``whitened`` and no part in that error. Repeated
    rows and null keys are rows of their own. An empty table gives no rows.
    """
    spark = table.sparkSession
    v = F.col("v")
    own = table.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").alias("v")).filter(valid(v))
    rows = durable(own.select("key", scaled(v, scale, shift).alias("x")))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dimension, n = lengths["d"], lengths["count"]
    rows = durable(indexed(durable(rows.filter(F.size("x") == dimension))))
    sums = means(rows, "x")
    parts = F.zip_with("x", F.lit(sums), lambda x, s: x * F.lit(n).cast("long") - s)  # exact
    rows = rows.select("index", "key", parts.alias("parts"))
    matrix = blocks(rows.select("index", F.transform("parts", lambda t: t / F.lit(float(n))).alias("c")), "c", n, dimension)
    variance = scatter(matrix) / n
    trace = float(np.trace(variance))
    values, vectors = eigen(variance, min(components, dimension))
    live = values > max(0.0, NOTHING * values[0])
    explained = [float(e) / trace if trace > 0 else None for e in values]
    error, count = None, int(live.sum())
    places = rows.select("index", "key", F.aggregate(
        "parts", F.lit(0).cast("decimal(38,0)"), lambda s, t: (s + t.cast("decimal(19,0)") * t.cast("decimal(19,0)")).cast("decimal(38,0)")).alias("deviation"))
    if count:
        found = durable(product(matrix, vectors[:, live] / np.sqrt(values[live]), spark))
        mean = [m / n for m in means(found, "values")]
        error = float(np.abs(covariance(found, "values", n, mean) - np.eye(count)).max())
        places = places.join(found, "index")
    else:
        places = places.withColumn("values", F.array().cast("array<double>"))
    each = F.transform(F.sequence(F.lit(0), F.lit(len(values) - 1)), lambda i: F.get("values", i))
    shares = F.lit(explained) if trace > 0 else F.array_repeat(F.lit(None).cast("double"), len(values))
    return places.select("key", "deviation", F.posexplode(each).alias("place", "whitened")).select(
        "key", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
