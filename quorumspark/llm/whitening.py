"""Whitening of embeddings by MLlib's BlockMatrix.

1. Vectors are numbered through and written; n and the sums of each dimension are exact.
2. Centred rows with their numbers become an IndexedRowMatrix and, dealt into blocks, a BlockMatrix; its transpose times
   itself is the scatter. The rows' dimension is cut into parts, so no task gets more than a few blocks at a time.
3. eigh of the scatter over n, of dimension by dimension, runs on the driver. The BlockMatrix times the whitening matrix
   (eigenvectors over the roots of their eigenvalues) projects the rows, which are joined with their ids by number.

Rows go to MLlib and come back within the JVM. MLlib's driver holds the places of all blocks, so there are at most BLOCKS.

Vectors are arrays of longs (see quantised()). Null vectors, and vectors with null or non-finite entries, are left out; so
are vectors of another length than most (the longest among equally frequent lengths). Null ids, repeated rows and equal
vectors each stay as rows of their own, columns besides the id and the vector play no part. An empty table gives no rows.
Components without variance (an eigenvalue below 1e-12 of the largest) have no whitened value and are not returned, so a
table of one vector, or of equal ones, gives no rows. Of equal eigenvalues any basis may come. deviation is null where it
exceeds a long.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Bytes of a block of doubles at least, about, and blocks at most.
BLOCK_BYTES, BLOCKS = 1_000_000, 1_000_000
#: The least eigenvalue, as a share of the largest, that counts as variance.
LEAST_SHARE = 1e-12


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def quantised(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))


def numbered(df: DataFrame) -> DataFrame:
    """df, written, with index: 0, 1, 2 and so on without gaps."""
    spark = df.sparkSession
    # the high bits are the number of the task that wrote the row, the low 33 its place there
    rows = materialize(df.withColumn("index", F.monotonically_increasing_id()), "vectors")
    part = F.shiftright("index", 33)
    before, n = [], 0
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], n))
        n += r["n"]
    offsets = spark.createDataFrame(before, "part long, before long")  # a row for each task
    placed = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.withColumn("index", F.col("before") + F.col("index").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before")


def row_matrix(rows: DataFrame, n: int, d: int) -> IndexedRowMatrix:
    """rows: index, v (an array of doubles)."""
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector"), n, d)


def rows_of(matrix: IndexedRowMatrix) -> DataFrame:
    """index, v of a matrix: its rows without a way through Python, which matrix.rows takes."""
    found = callMLlibFunc("getIndexedRows", matrix._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("v"))


def product(a: BlockMatrix, b: BlockMatrix, parts: int) -> BlockMatrix:
    """a times b, with the dimension between them cut into so many parts: MLlib's multiply(other, numMidDimSplits), which
    PySpark's own multiply() lacks; without it all blocks go to the one task of the result's one block."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def whitened(df: DataFrame, id_column: str, vector: str, components: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df: vectors of longs. A row for each of them and component, by falling eigenvalue: id_column, component (from 1),
    n, deviation (n squared times the squared distance from the mean), whitened, explained (the component's share of the
    variance) and identity_error (the largest deviation of the whitened rows' covariance from the identity)."""
    spark = df.sparkSession
    c = F.col
    nothing = spark.createDataFrame([], f"`{id_column}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    vectors = df.where(c(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())).select(c(id_column).cast("long").alias("id"), c(vector).alias("x"))
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return nothing
    d, n = lengths
    rows = numbered(vectors.where(F.size("x") == d))
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).orderBy("i").collect()
    total = F.from_json(F.lit(json.dumps([r["s"] for r in sums])), "array<bigint>")
    apart = F.zip_with("x", total, lambda x, s: F.lit(n).cast("long") * x - s)  # n times the centred vector, exactly
    size = max(1, block_bytes // (8 * d), -(-n // BLOCKS))
    centred = rows.select("index", F.transform(apart, lambda x: x.cast("double") / n).alias("v"))
    matrix = row_matrix(centred, n, d).toBlockMatrix(size, d)
    blocks = -(-n // size)
    parts = min(blocks, max(2 * spark.sparkContext.defaultParallelism, blocks // 16))
    covariance = product(matrix.transpose(), matrix, parts).toLocalMatrix().toArray() / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    k = int(min(components, (values > LEAST_SHARE * values[0]).sum())) if values[0] > 0 else 0
    if not k:
        return nothing
    whitener = basis[:, :k] / np.sqrt(values[:k])
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, whitener.ravel(), True))], 1), d, k, d, k)
    projected = materialize(rows_of(product(matrix, right, 1).toIndexedRowMatrix()), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = projected.agg(*(F.avg(c("v")[i] * c("v")[j]) for i, j in pairs)).first()
    error = max(abs(m - (i == j)) for m, (i, j) in zip(means, pairs, strict=True))
    explained = F.from_json(F.lit(json.dumps((values[:k] / np.trace(covariance)).tolist())), "array<double>")
    squares = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    named = rows.select("index", "id", squares.try_cast("long").alias("deviation")).join(projected, "index")
    each = named.select("id", "deviation", F.posexplode("v").alias("i", "whitened"))
    return each.select(c("id").alias(id_column), (c("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, c("i")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), 1024, 100_000).alias("x"))
    return whitened(rows, "vec_id", "x")
