"""Embedding whitening with block matrices.

Entries become integers, so sums and deviations are exact. Centred rows are indexed and cut into
distributed blocks; the blocks multiplied by their transpose are the scatter matrix, whose
eigenvectors are found where the driver runs (it is as large as the square of the dimension, not as
the table); the blocks multiplied by the whitening matrix are the projected rows.

MLlib keeps the numbers of all blocks on the driver and, for a tall matrix, multiplies in as many
tasks as the root of its partitions; so a long table is worked on in stripes of a bounded number of
blocks, and scatter products are cut along the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BLOCK_BYTES = 4 << 20
BLOCKS_PER_STRIPE = 4096
LONG = (1 << 63) - 1
# Beyond this distance from the identity the whitening matrix is corrected by what the rows show.
EXACT_ENOUGH, CORRECTIONS = 1e-9, 3
PARTITION_BITS = 33  # of monotonically_increasing_id: the rows of a partition


@dataclass(frozen=True)
class Whitening:
    """rows: id, deviation, whitened (array of double), and what holds for all of them."""

    rows: DataFrame
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    matrix: np.ndarray
    identity_error: float


def integer_vectors(table: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """key, id, x of the rows that can be used, written; and their dimension.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out. So are
    rows of another dimension than most rows have (of ties, the larger dimension is taken).
    """
    entry = F.col("v")
    finite = F.forall(entry, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.filter(entry.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return rows.limit(0), 0
    dimension = commonest["d"]
    x = F.transform("v", lambda e: F.least(F.floor(F.lit(float(SCALE)) * e), F.lit(LONG - SHIFT)) + F.lit(SHIFT))
    kept = rows.filter(F.size("v") == dimension).select(F.monotonically_increasing_id().alias("key"), "id", x.alias("x"))
    return written(kept, "vectors"), dimension


def entries_of(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def totals(vectors: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension; a task sends one row per dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        count, sums = 0, [0] * dimension
        for batch in batches:
            x = entries_of(batch.column("x"), dimension)
            if len(x):
                small = float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
                part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, part)]
                count += len(x)
        yield pa.record_batch([pa.array(range(dimension), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
                               pa.array([count] * dimension, pa.int64())], names=["at", "total", "n"])

    found = vectors.select("x").mapInArrow(work, "at int, total decimal(38,0), n bigint")
    rows = found.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    return rows[0]["n"], [int(r["total"]) for r in rows]


def centred_rows(vectors: DataFrame, dimension: int, n: int, sums: list[int]) -> DataFrame:
    """index, id, deviation, centred of each vector, written; indexes go from 0 without a gap.

    A deviation that no long can hold is null.
    """
    schema = f"key bigint, id {vectors.schema['id'].dataType.simpleString()}, deviation bigint, centred array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = entries_of(batch.column("x"), dimension)
            if not len(x):
                continue
            # Differences in floating point tell whether integers of 64 bits suffice.
            far = float(np.abs(x.astype(float) - np.array(sums, dtype=float) / n).max()) + 1
            top = max(float(np.abs(x.astype(float)).max()), 1.0)
            small = n * top < 2.0**62 and (n * far) ** 2 * dimension < 2.0**62
            kind = np.int64 if small else object
            from_mean = n * x.astype(kind) - np.array(sums, dtype=kind)
            squares = (from_mean * from_mean).sum(axis=1)
            deviation = [int(v) if v <= LONG else None for v in squares]
            centred = from_mean.astype(float) / n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, centred.size + 1, dimension), pa.int32()), pa.array(centred.ravel()))
            yield pa.record_batch([batch.column("key"), batch.column("id"), pa.array(deviation, pa.int64()), lists],
                                  names=["key", "id", "deviation", "centred"])

    rows = vectors.mapInArrow(work, schema).withColumn("part", F.shiftright("key", PARTITION_BITS))
    # One row per partition that wrote vectors goes through this window.
    sizes = vectors.groupBy(F.shiftright("key", PARTITION_BITS).alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    index = F.col("start") + F.col("key").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    return written(rows.join(starts, "part").select(index.alias("index"), "id", "deviation", "centred"), "centred")


def stripes(rows: DataFrame, n: int, width: int, column: str, per_block: int) -> Iterator[tuple[int, BlockMatrix, int]]:
    """`rows` (index, `column`) as block matrices: first index, matrix and number of row blocks of each."""
    length = per_block * BLOCKS_PER_STRIPE
    for start in range(0, n, length):
        part = rows.filter((F.col("index") >= start) & (F.col("index") < start + length))
        frame = part.select((F.col("index") - start).alias("index"), array_to_vector(column).alias("vector"))
        size = min(length, n - start)
        matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(frame, "vector"), size, width)
        yield start, matrix.toBlockMatrix(per_block, per_block), -(-size // per_block)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left times right; the inner dimension is cut into `splits`, which the Python method cannot ask for."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def covariance(rows: DataFrame, n: int, width: int, column: str, per_block: int) -> np.ndarray:
    """The scatter matrix of centred rows over their number."""
    total = 0.0
    for _, blocks, count in stripes(rows, n, width, column, per_block):
        total = total + product(blocks.transpose(), blocks, count).toLocalMatrix().toArray()
    return total / n


def projected(rows: DataFrame, n: int, column: str, per_block: int, matrix: np.ndarray) -> DataFrame:
    """index, whitened: `rows` multiplied by `matrix`."""
    spark = rows.sparkSession
    small = IndexedRowMatrix(spark.sparkContext.parallelize(list(enumerate(matrix.tolist())), 1)).toBlockMatrix(per_block, per_block)
    out = None
    for start, blocks, _ in stripes(rows, n, len(matrix), column, per_block):
        java = product(blocks, small).toIndexedRowMatrix()._java_matrix_wrapper._java_model
        part = callMLlibFunc("getIndexedRows", java)
        part = part.select((F.col("index") + start).alias("index"), vector_to_array("vector").alias("whitened"))
        out = part if out is None else out.unionAll(part)
    return written(out, "whitened")


def whitening_matrix(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are not zero, falling, and the columns that whiten; `components` at most."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = max(values[0], 0.0) * len(values) * 10 * np.finfo(float).eps
    keep = min(components, int((values > floor).sum()))
    return values[:keep], vectors[:, :keep] / np.sqrt(values[:keep])


def rotated(matrix: np.ndarray, sweeps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and eigenvectors by Jacobi rotations, which keep small eigenvalues beside large ones exact."""
    a, turned = matrix.copy(), np.eye(len(matrix))
    for _ in range(sweeps):
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) > np.finfo(float).eps * np.sqrt(abs(a[p, p] * a[q, q])):
                    slope = (a[q, q] - a[p, p]) / (2 * a[p, q])
                    t = (1.0 if slope >= 0 else -1.0) / (abs(slope) + np.hypot(slope, 1.0))
                    c = 1 / np.hypot(t, 1.0)
                    turn = np.array([[c, t * c], [-t * c, c]])
                    a[:, [p, q]] = a[:, [p, q]] @ turn
                    a[[p, q], :] = turn.T @ a[[p, q], :]
                    turned[:, [p, q]] = turned[:, [p, q]] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


def centred_again(rows: DataFrame, n: int, width: int) -> DataFrame:
    """`whitened` less its mean, which is zero but for rounding."""
    mean = rows.agg(*[(F.sum(F.get("whitened", F.lit(i))) / n).alias(f"m{i}") for i in range(width)]).first()
    means = F.array(*[F.lit(m) for m in mean])
    return rows.select("index", F.zip_with("whitened", means, lambda a, b: a - b).alias("whitened"))


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> Whitening:
    """Rows of `table` projected on the components of largest variance, with unit variance and no correlation.

    An entry c counts as floor(64 * c) + 1000000; an entry whose integer no long can hold counts as the
    nearest long. The mean and the covariance are those of all vectors that can be used (see
    `integer_vectors`). A component without variance beyond rounding is left out, so there may be
    fewer than asked for, and none for one vector or equal ones. A null id stays null; repeated rows
    count and come back each. Without usable vectors there are no rows.
    """
    vectors, dimension = integer_vectors(table, id_column, vector_column)
    kind = table.schema[id_column].dataType.simpleString()
    none = table.sparkSession.createDataFrame([], f"id {kind}, deviation bigint, whitened array<double>")
    if not dimension:
        return Whitening(none, 0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = totals(vectors, dimension)
    rows = centred_rows(vectors, dimension, n, sums)
    per_block = max(dimension, BLOCK_BYTES // (8 * dimension), 1)
    cov = covariance(rows, n, dimension, "centred", per_block)
    values, matrix = whitening_matrix(cov, components)
    if not len(values):
        empty = F.array().cast("array<double>").alias("whitened")
        return Whitening(rows.select("id", "deviation", empty), n, sums, values, values, matrix, 0.0)
    for _ in range(CORRECTIONS):
        out = projected(rows, n, "centred", per_block, matrix)
        seen = covariance(centred_again(out, n, len(values)), n, len(values), "whitened", per_block)
        error = float(np.abs(seen - np.eye(len(seen))).max())
        if error <= EXACT_ENOUGH:
            break
        # What the rows show is nearer to the truth than a covariance with one very large entry.
        lengths = np.linalg.norm(matrix, axis=0)
        units = matrix / lengths
        values, turned = rotated((seen + seen.T) / 2 / np.outer(lengths, lengths))
        units = units @ turned
        matrix = units / np.linalg.norm(units, axis=0) / np.sqrt(values)
    whitened = rows.select("index", "id", "deviation").join(out, "index").drop("index")
    return Whitening(whitened, n, sums, values, values / np.trace(cov), matrix, error)
