"""Whitening of vectors with distributed block matrices.

Distinct vectors are the fit list. Its rows, centred exactly before they become floating
point, are indexed into blocks of a BlockMatrix; its transpose times itself is the scatter,
whose columns' count is the vectors' length, so that it alone is decomposed locally. All
rows, centred likewise, form a second BlockMatrix, whose product with the whitening matrix
projects them. The rows that are multiplied never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import store

#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLS = 1024, 1024
#: Tasks among which the products of blocks are dealt before they are summed, at most.
SPLITS = 512
#: Vectors up to this length are decomposed; their square matrix is all that the driver holds.
MOST_DIMENSIONS = 8192
#: Entries beyond it have no exact whole number here and count like those that are not finite.
LARGEST = float(1 << 30)
#: A component whose share of the variance is below this has none.
LEAST_SHARE = 1e-13


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): vectors of floor(scale * c) + shift as longs; null vectors and those with null or non-finite entries go."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    whole = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift))
    return table.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


@dataclass
class Sums:
    """Of the fit list: rows, and each dimension's sum, least and largest entry."""

    n: int
    total: list[int]
    least: list[int]
    most: list[int]

    def fits(self) -> bool:
        """Whether n * x - S and the sum of its squares stay within a long."""
        far = [max(abs(self.n * a - s), abs(self.n * b - s)) for s, a, b in zip(self.total, self.least, self.most, strict=True)]
        return sum(f * f for f in far) < 1 << 63 and all(self.n * max(abs(a), abs(b)) < 1 << 62 for a, b in zip(self.least, self.most, strict=True))


def sums_of(fit: DataFrame, width: int) -> Sums:
    """Exact sums: every task sends one row of each dimension, which Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, [0] * width, None, None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(-1, width)
                n += len(x)
                for part in np.array_split(x, -(-len(x) // 65536)):  # 2^16 entries below 2^46 add up within a long
                    total = [a + int(b) for a, b in zip(total, part.sum(axis=0), strict=True)]
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            kinds = [pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
            data = [list(range(width)), [n] * width, [Decimal(t) for t in total], least.tolist(), most.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], names=["i", "n", "total", "least", "most"])

    found = fit.select("x").mapInArrow(run, "i long, n long, total decimal(38,0), least long, most long")
    added = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total")).alias("t"), F.min("least").alias("a"), F.max("most").alias("b"))
    rows = sorted(added.collect(), key=lambda r: r.i)
    return Sums(rows[0].n, [int(r.t) for r in rows], [r.a for r in rows], [r.b for r in rows])


def offsets(x: Column, sums: Sums) -> Column:
    """n * x - S by dimension, exact: longs where they fit, else decimals."""
    kind = "long" if sums.fits() else "decimal(38,0)"
    totals = F.array(*[F.lit(str(t)).cast(kind) for t in sums.total])
    n = F.lit(sums.n).cast("long" if kind == "long" else "decimal(18,0)")
    less = lambda a, s: ((a if kind == "long" else a.cast("decimal(19,0)")) * n - s).cast(kind)
    return F.zip_with(x, totals, less)


def indexed(rows: DataFrame) -> DataFrame:
    """`rows` (stored, with `at` of monotonically_increasing_id) with gapless numbers `row`; one number a partition comes to the driver."""
    part = F.shiftright("at", 33)
    counts = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, run = [], 0
    for r in counts:
        starts.append((r.part, run))
        run += r.n
    table = rows.sparkSession.createDataFrame(starts, "part long, start long")
    joined = rows.withColumn("part", part).join(F.broadcast(table), "part")
    return joined.withColumn("row", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "at")


def block_matrix(rows: DataFrame, values: str, n: int, width: int) -> BlockMatrix:
    """A BlockMatrix of the array column `values`, placed by `row`."""
    vectors = rows.select(F.col("row").cast("long").alias("index"), array_to_vector(values).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    # every product asks for the blocks several times; those of a lost executor are made again from the table
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, BLOCK_COLS).persist(StorageLevel.DISK_ONLY)


def release(a: BlockMatrix) -> None:
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(a: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself, summed from products that are dealt among many tasks; a square of its width."""
    left = a.transpose()
    splits = max(1, min(SPLITS, a.numRowBlocks))
    # the split of the inner dimension is an argument of the JVM's method; without it one task would get all blocks
    java = left._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def project(sc: SparkContext, a: BlockMatrix, w: np.ndarray) -> DataFrame:
    """(row, projected) of the matrix times `w`, by block multiplication."""
    cuts = range(0, w.shape[0], a.colsPerBlock)
    blocks = [((i, 0), Matrices.dense(*(part := w[at : at + a.colsPerBlock]).shape, part.ravel(order="F").tolist())) for i, at in enumerate(cuts)]
    right = BlockMatrix(sc.parallelize(blocks, 1), a.colsPerBlock, w.shape[1], w.shape[0], w.shape[1])
    rows = callMLlibFunc("getIndexedRows", a.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows.toDF("row", "v"), "v").select("row", vector_to_array("v").alias("projected"))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down, and unit eigenvectors by column, the largest entry of each positive."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * np.where(signs == 0, 1, signs)


@dataclass
class Whitening:
    """A fit: sums of the fit list, eigenvalues, and the matrix that whitens centred rows, a column a component."""

    sums: Sums
    values: np.ndarray
    explained: list[float | None]
    matrix: np.ndarray
    identity_error: float | None


def fit_whitening(fit: DataFrame, width: int, components: int) -> Whitening:
    """`fit`: distinct vectors `x` of one length, with gapless `row`."""
    sums = sums_of(fit, width)
    centred = fit.select("row", F.transform(offsets(F.col("x"), sums), lambda d: d.cast("double") / F.lit(float(sums.n))).alias("c"))
    a = block_matrix(centred, "c", sums.n, width)
    values, vectors = eigen(scatter(a) / sums.n)
    trace = float(values.sum())
    kept = [i for i in range(min(components, width)) if trace > 0 and values[i] / trace > LEAST_SHARE]
    matrix = np.zeros((width, min(components, width)))
    matrix[:, kept] = vectors[:, kept] / np.sqrt(values[kept])
    error = None
    if kept:
        white = store(project(fit.sparkSession.sparkContext, a, matrix), "whitening-fit").select("row", F.col("projected").alias("c"))
        means = np.array([float(r.m) for r in sorted(white.select(F.posexplode("c").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).collect())])
        shifted = white.select("row", F.zip_with("c", F.array(*[F.lit(float(m)) for m in means]), lambda c, m: c - m).alias("c"))
        b = block_matrix(shifted, "c", sums.n, matrix.shape[1])
        got = scatter(b) / sums.n
        release(b)
        error = float(np.abs(got[np.ix_(kept, kept)] - np.eye(len(kept))).max())
    release(a)
    explained = [float(values[i]) / trace if trace > 0 else None for i in range(matrix.shape[1])]
    return Whitening(sums, values, explained, matrix, error)


_RESULT = (
    "vec_id long, dimensions int, n long, deviation long, deviation_exact decimal(38,0), "
    "whitened array<double>, explained array<double>, identity_error double"
)


def whiten(table: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dimensions, n, deviation, whitened, explained, identity_error): every row's first components, as lists.

    Rows with a null or empty vector, or one with null or non-finite entries (or beyond 2^30,
    which have no exact whole number), take no part. Vectors of each length, of which there
    are few, have a fit of their own. The fit list holds every distinct vector once; rows
    that repeat a vector or an id, or have no id, each come back. A component without variance
    has a null `whitened`; where nothing varies, explained and identity_error are null too. A
    deviation beyond a long is null, `deviation_exact` has it as a decimal. Vectors longer than
    MOST_DIMENSIONS raise. An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    numbered = lambda df, label: store(df.withColumn("at", F.monotonically_increasing_id()), label)
    rows = numbered(whole_vectors(table, id_col, vector_col, scale, shift), "whitening-rows")
    out, widths = None, sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    for width in widths:
        if width > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {width} entries: the limit is {MOST_DIMENSIONS}")
        own = rows if len(widths) == 1 else numbered(rows.where(F.size("x") == width).drop("at"), "whitening-rows")
        fit = numbered(own.select("x").distinct(), "whitening-distinct")
        model = fit_whitening(indexed(fit), width, components)
        part = _applied(indexed(own), own.count(), width, model)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _RESULT)
    return out


def _applied(rows: DataFrame, count: int, width: int, model: Whitening) -> DataFrame:
    """`rows` (vec_id, x, row) whitened by `model`."""
    sums = model.sums
    exact = F.col("d")
    kind = "long" if sums.fits() else "decimal(38,0)"
    squares = F.aggregate(exact, F.lit(0).cast(kind), lambda s, d: (s + (d * d).cast(kind)).cast(kind))
    made = rows.select("vec_id", "row", offsets(F.col("x"), sums).alias("d"))
    made = store(made.select("vec_id", "row", squares.alias("deviation_exact"), F.transform("d", lambda d: d.cast("double") / F.lit(float(sums.n))).alias("c")), "whitening-centred")
    a = block_matrix(made, "c", count, width)
    found = store(project(rows.sparkSession.sparkContext, a, model.matrix), "whitening-projected")
    release(a)
    empty = [i for i in range(model.matrix.shape[1]) if not model.matrix[:, i].any()]
    values = F.transform("projected", lambda v, i: F.when(~i.isin(empty), v)) if empty else F.col("projected")
    found = made.drop("c").join(found, "row")
    return found.select(
        "vec_id",
        F.lit(width).alias("dimensions"),
        F.lit(sums.n).cast("long").alias("n"),
        F.col("deviation_exact").try_cast("long").alias("deviation"),
        F.col("deviation_exact").cast("decimal(38,0)").alias("deviation_exact"),
        values.alias("whitened"),
        F.array(*[F.lit(e).cast("double") for e in model.explained]).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def by_component(whitened: DataFrame) -> DataFrame:
    """A row per vector and component, numbered from 1."""
    both = F.arrays_zip("whitened", "explained")
    long = whitened.select("vec_id", "n", "deviation", "identity_error", F.posexplode(both).alias("i", "z"))
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
