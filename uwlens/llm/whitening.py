"""Embedding whitening with MLlib's distributed BlockMatrix.

1. Components become integers (``vectors``).  The fit list is each distinct vector once; its number ``n`` and
   its exact sums per dimension come from aggregations.
2. The centred rows of the fit list are numbered and cut into distributed blocks (``IndexedRowMatrix`` to
   ``BlockMatrix``, one block wide).  Transposed times itself gives the scatter matrix.  A product with one
   result block would meet in one task; ``numMidDimSplits`` deals the row blocks to many tasks, at most
   ``BLOCKS_A_TASK`` to each, whose products are summed.
3. The scatter matrix (dimension x dimension, whatever the number of rows) is decomposed on the driver, and a
   second BlockMatrix product projects rows: the fit list for the check of the result, all rows for the output.

Rows are projected by row number, never joined by their vector, so a vector that a third of all rows share is
no hot key.  MLlib numbers a matrix's rows with 32 bits and lists its blocks on the driver; both are bounded by
working in panels of at most ``PANEL_ROWS`` rows, whose scatter matrices add up.

Defined results: a null vector and one with a null, NaN or infinite component take no part; a null or repeated
id is an id like others; repeated rows each have their result; a shorter vector counts as zero in the dimensions
it lacks, the empty vector as zero in all; components whose eigenvalue is zero up to rounding are left out, so
an empty table, a single distinct vector and vectors without components give no rows.  Of an eigenvector's two
signs the one with the largest entry positive is taken.  Columns other than the two named are ignored.  All
integers are exact while a dimension's sum fits bigint (Spark raises an error beyond it); ``deviation`` is a
decimal because it passes bigint first.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .vectors import even_length, integer_vectors, numbered

COMPONENTS = 4
BLOCK_BYTES = 4 << 20
BLOCKS_A_TASK = 4
PANEL_ROWS = 1 << 26
_TASK_BYTES = 64 << 20
_OUT = "vec_id {id}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


class _Blocks:
    """Centred rows of a numbered table as block matrices, one for each panel."""

    def __init__(self, rows: DataFrame, n: int, dims: int, mean: list[float]):
        self.rows, self.n, self.dims, self.mean = rows, n, dims, mean
        self.per_block = max(1, min(BLOCK_BYTES // (8 * dims), ceil(n / partitions(rows.sparkSession))))

    def panels(self) -> list[tuple[int, BlockMatrix]]:
        return [(low, self._panel(low, min(PANEL_ROWS, self.n - low))) for low in range(0, self.n, PANEL_ROWS)]

    def _panel(self, low: int, rows: int) -> BlockMatrix:
        centred = F.zip_with("x", F.array(*[F.lit(m) for m in self.mean]), lambda c, m: c - m)
        part = self.rows.where(F.col("row_no").between(low, low + rows - 1)).select(
            (F.col("row_no") - low).alias("index"), array_to_vector(centred).alias("vector"))
        least = ceil(rows * self.dims * 8 / _TASK_BYTES)  # the blocks are made in as many tasks as the rows come from
        if part.rdd.getNumPartitions() < least:
            part = part.repartition(least, "index")
        part = MLUtils.convertVectorColumnsFromML(part, "vector")
        return IndexedRowMatrix(part, rows, self.dims).toBlockMatrix(self.per_block, self.dims)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transposed times itself, over many tasks (the Python class has no argument for the splits)."""
    flat = blocks.transpose()
    splits = max(1, ceil(blocks.numRows() / blocks.rowsPerBlock / BLOCKS_A_TASK))
    product = flat._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, flat.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _projected(blocks: BlockMatrix, matrix: BlockMatrix) -> BlockMatrix:
    return blocks.multiply(matrix)


def _rows_of(blocks: BlockMatrix, low: int) -> DataFrame:
    """(row_no, whitened) of a projected panel."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select((F.col("index") + low).alias("row_no"), vector_to_array("vector").alias("whitened"))


def leading_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of at most ``most`` components above rounding."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > np.finfo(float).eps * len(values) * max(np.trace(covariance), 0.0)
    values, vectors = values[real][:most], vectors[:, real][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    every, dims, total = even_length(numbered(integer_vectors(rows, id_col, vector_col), scratch, "vectors"))
    nothing = spark.createDataFrame([], _OUT.format(id=every.schema["vec_id"].dataType.simpleString()))
    if not total or not dims:
        return nothing
    fit = numbered(every.select("x").distinct(), scratch, "fit")
    n = fit.count()
    sums = [s for _, s in sorted(fit.select(F.posexplode("x").alias("dim", "c")).groupBy("dim").agg(F.sum("c").alias("s")).collect())]
    mean = [s / n for s in sums]

    listed = _Blocks(fit, n, dims, mean).panels()
    covariance = sum(_scatter(blocks) for _, blocks in listed) / n
    values, vectors = leading_components(covariance, components)
    if not len(values):
        return nothing
    whitening = vectors / np.sqrt(values)
    matrix = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, len(values), whitening.flatten("F").tolist()))], 1),
                         dims, len(values))
    spread = sum(_scatter(_projected(blocks, matrix)) for _, blocks in listed) / n
    error = float(np.abs(spread - np.eye(len(values))).max())

    projected = [scratch.save(_rows_of(_projected(blocks, matrix), low), f"projected{low}")
                 for low, blocks in _Blocks(every, total, dims, mean).panels()]
    white = projected[0]
    for more in projected[1:]:
        white = white.unionByName(more)
    # sum of (n x - S)^2 = n^2 sum x^2 - 2 n sum x S + sum S^2, in whole numbers
    exact = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    squares = F.aggregate("x", F.lit(0).cast("bigint"), lambda t, c: t + c * c).cast("decimal(19,0)")
    crossed = F.aggregate(F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in sums]), lambda c, s: c * s),
                          F.lit(0).cast("bigint"), lambda t, c: t + c).cast("decimal(19,0)")
    deviation = (exact(n * n) * squares - exact(2 * n) * crossed + exact(sum(s * s for s in sums))).cast("decimal(38,0)")
    shares = [float(v) for v in values / np.trace(covariance)]
    return (every.select("row_no", "vec_id", deviation.alias("deviation")).join(white, "row_no")
            .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1).alias("explained"),
                    F.lit(error).alias("identity_error")))
