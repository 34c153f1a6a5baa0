"""Embedding whitening (operator 13): centred rows in an MLlib BlockMatrix, transpose-multiply for the scatter, a local eigendecomposition,
and a BlockMatrix multiplication that projects the rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import checkpoint_dir

COMPONENTS = 4
#: Entries are scaled by this and rounded down, so that sums are exact.
SCALE = 256
#: Rows and columns of a block: at most 8 MB of doubles.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: Row blocks that one task of the transpose-multiplication takes.
BLOCKS_PER_SPLIT = 4
#: The scatter (dimensions squared) is the one thing that the driver holds: 512 MB at this bound.
MOST_DIMENSIONS = 8192
#: Components with less than this share of the variance count as none.
NEGLIGIBLE = 1e-12


def scaled(embedding: Column) -> Column:
    """Entries as whole numbers; null for a vector that is null or holds null or non-finite entries."""
    c = lambda v: v.cast("double")
    sound = F.forall(embedding, lambda v: F.coalesce(~F.isnan(v) & (F.abs(c(v)) < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(embedding, lambda v: F.floor(c(v) * SCALE).cast("long")))


def dense_index(rows: DataFrame) -> DataFrame:
    """rows with idx, numbered from 0 without gaps, and checkpointed. What the driver collects is one count for each partition."""
    kept = rows.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    before, first = [], 0
    for p, n in sorted(tuple(r) for r in kept.groupBy(part.alias("p")).count().collect()):
        before.append((p, first))
        first += n
    shifts = kept.sparkSession.createDataFrame(before, "__part long, __before long")
    # a row of 16 bytes for each partition
    out = kept.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return out.withColumn("idx", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def block_matrix(rows: DataFrame, centred: Column, n_rows: int, n_columns: int) -> BlockMatrix:
    """Rows of doubles by idx as distributed blocks; nothing passes through Python."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("idx").alias("index"), array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n_rows, n_columns).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(m: BlockMatrix) -> np.ndarray:
    """m transposed times m. The middle dimension is split, so that each task takes a few row blocks and sends one sum."""
    splits = max(1, -(-m.numRows() // (BLOCK_ROWS * BLOCKS_PER_SPLIT)))
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()


def projected(m: BlockMatrix, w: np.ndarray) -> DataFrame:
    """(idx, whitened array) of the rows of m times w."""
    sc = m._java_matrix_wrapper._sc
    blocks = [((k, 0), Matrices.dense(len(part), w.shape[1], part.ravel("F").tolist())) for k, part in enumerate(w[i : i + BLOCK_COLUMNS] for i in range(0, len(w), BLOCK_COLUMNS))]
    right = BlockMatrix(sc.parallelize(blocks, len(blocks)), BLOCK_COLUMNS, w.shape[1], len(w), w.shape[1])
    product = m.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("idx"), vector_to_array("vector").alias("whitened"))


def _identity_error(fitted: DataFrame, used: list[int]) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over the components in use; centred first."""
    if not used:
        return 0.0
    w = lambda i: F.get("whitened", F.lit(i))
    means = fitted.agg(*[F.avg(w(i)) for i in used]).first()
    centred = [w(i) - m for i, m in zip(used, means, strict=True)]
    pairs = [(i, j) for i in range(len(used)) for j in range(i + 1)]
    entries = fitted.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(entries, pairs, strict=True))


RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """RESULT: a row for each sound vector and component.

    Vectors that are null or hold null or non-finite entries go. So do vectors of another length than the commonest (of equally common
    lengths, the greatest): they have no place in one space. The fit list has each distinct vector once, so repeated rows weigh
    nothing more, and repeated or null ids stay rows of their own. Components whose variance is negligible (one distinct vector, dependent
    dimensions) have whitened 0.0 and count for nothing in identity_error. deviation is exact; one beyond 64 bits is null. An
    empty table, or none but empty vectors, gives an empty result. Other columns are not read.

    A common vector is one row of the fit list after a map-side distinct; rows are dealt by their number, not by what they hold, and
    are projected where they lie, so no key gathers them. The driver holds the scatter alone (dimensions squared).
    """
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("x")).where("x is not null")
    rows = rows.checkpoint()
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or not common["d"]:
        return spark.createDataFrame([], RESULT)
    d = common["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the driver takes {MOST_DIMENSIONS}")
    every = dense_index(rows.where(F.size("x") == d))
    fit = dense_index(every.select("x").distinct())
    v = F.col("v")
    sums = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(v.cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("k").collect()
    n, s, n_rows = sums[0]["n"], [int(r["s"]) for r in sums], every.count()
    # the entries are bounded, so it is known beforehand whether 64 bits hold the squares
    wide = d * (2 * n * max(max(abs(r["lo"]), abs(r["hi"])) for r in sums)) ** 2 >= 1 << 63
    kind = "decimal(38,0)" if wide else "bigint"
    total = F.array(*[F.lit(str(t)).cast(kind) for t in s])
    if wide:
        apart = F.zip_with("x", total, lambda x, t: (x.cast("decimal(20,0)") * F.lit(n) - t).cast(kind))
        squares = F.aggregate(apart, F.lit(0).cast(kind), lambda a, x: F.try_add(a, F.try_multiply(x, x)).try_cast(kind))
        deviation = squares.try_cast("bigint")
    else:
        apart = F.zip_with("x", total, lambda x, t: x * F.lit(n) - t)
        deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda a, x: a + x * x)
    centred = F.transform(apart, lambda x: x.cast("double") / F.lit(float(n)))

    m = block_matrix(fit, centred, n, d).cache()
    cov = scatter(m) / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(cov))
    used = [k for k, i in enumerate(order) if values[i] > NEGLIGIBLE * max(trace, 0.0)]
    w = np.zeros((d, len(order)))
    for k in used:
        axis = axes[:, order[k]]
        w[:, k] = axis * np.sign(axis[np.abs(axis).argmax()]) / np.sqrt(values[order[k]])
    error = _identity_error(projected(m, w), used)

    out = projected(block_matrix(every, centred, n_rows, d), w).join(every.select("idx", "id", deviation.alias("deviation")), "idx")
    share = F.lit([float(values[i] / trace) if k in used else 0.0 for k, i in enumerate(order)])
    out = out.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op13: whitened embeddings, four components each."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
