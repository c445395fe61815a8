"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; a pivot's vectors lie
in annuli of that distance. For a query q, an annulus of pivot p with distances from a to
b holds no score above

    min(q.p + |q| b, (|q|^2 + M^2 - gap^2) / 2),  gap = max(0, d(q, p) - b, a - d(q, p)),

by Cauchy-Schwarz and by the triangle inequality, M being the annulus's largest norm. A query
sorts the annuli by their bounds and expands the first few; its k-th score from these, or
from the pivots' own sample, is the score below which it stops: of the other annuli only
those whose bound reaches it are expanded. Queries meet annuli in a join, page by page, so no
part of the search runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import store
from propspark.llm.vector_pages import ASKED, MOST, best_of_cells, matrix, page_counts, question_rows, ranked
from propspark.llm.vector_pages import exact_products as products

#: Vectors from which pivots are chosen and first bounds come, those whose ids hash lowest, and numbers that they hold at most.
SAMPLE, NUMBERS = 4096, 1 << 20
PIVOTS = 64
#: Vectors that an annulus is meant to hold; a pivot's edges are quantiles of the sample's distances, so there are at most so many.
RING_ROWS, MOST_RINGS = 1024, 1024
#: Annuli that a query expands before it takes its k-th score for the rest.
FIRST = 8
#: Bounds that a task holds at once.
BOUNDS = 1 << 21
SEED = 42


def scaled_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): whole vectors of floor(scale * x) as longs; rows with no, null or non-finite parts or a null id go."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    return table.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice, starting at the first row."""
    points = sample.astype(np.float64)
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    p = points.astype(np.float64)
    return np.sqrt(np.maximum(0, (p**2).sum(axis=1)[:, None] - 2 * p @ pivots.T + (pivots**2).sum(axis=1)[None, :]))


def ring_edges(points: np.ndarray, pivots: np.ndarray, rings: int) -> np.ndarray:
    """Inner edges of each pivot's annuli, one row a pivot."""
    d = distances(points, pivots)
    nearest, least = d.argmin(axis=1), d.min(axis=1)
    shares = np.arange(1, rings) / rings
    return np.stack([np.quantile(least[nearest == p], shares) if (nearest == p).any() else np.zeros(rings - 1) for p in range(len(pivots))])


def build_index(vectors: DataFrame, pivots: np.ndarray, edges: np.ndarray) -> DataFrame:
    """`vectors` with annulus (`cell`), distance to its pivot and norm; every row is indexed."""
    width, rings = pivots.shape[1], edges.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column(2), width)
                d = distances(points, pivots)
                nearest, least = d.argmin(axis=1), d.min(axis=1)
                cell = nearest * rings + (edges[nearest] <= least[:, None]).sum(axis=1)
                norm = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
                label = np.zeros(len(points), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(least), pa.array(cell), pa.array(norm)], names=["row", "vec_id", "v", "label", "distance", "cell", "norm"])

    keyed = vectors.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<long>, label long, distance double, cell long, norm double")
    return store(keyed, "topk-index")


def bounds(to_pivot, on_pivot, norms, near, far, largest):
    """No score of the queries in an annulus is above this; arrays that go together."""
    gap = np.maximum(0, np.maximum(to_pivot - far, near - to_pivot))
    bound = np.minimum(on_pivot + norms * far, (norms**2 + largest**2 - gap**2) / 2)
    return bound + 1e-6 * (1 + np.abs(bound))


class Annuli:
    """Pivots, and of each annulus that holds vectors: number, pivot, nearest and farthest distance, largest norm."""

    def __init__(self, pivots: np.ndarray, cells: np.ndarray, near: np.ndarray, far: np.ndarray, largest: np.ndarray, rings: int):
        self.pivots, self.cells, self.near, self.far, self.largest = pivots, cells, near, far, largest
        self.of = cells // rings

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """The most that a score of each query can be in each annulus."""
        to_pivot, on_pivot = distances(v, self.pivots), v.astype(np.float64) @ self.pivots.T
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))[:, None]
        return bounds(to_pivot[:, self.of], on_pivot[:, self.of], norms, self.near, self.far, self.largest)

    def expand(self, v: np.ndarray, floors: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of annulus) of the FIRST annuli by bound, or of the rest, as far as a bound reaches the floor."""
        found = self.bounds(v)
        order = np.argsort(-found, axis=1, kind="stable")
        mine = np.zeros(found.shape, dtype=bool)
        np.put_along_axis(mine, order[:, :FIRST] if first else order[:, FIRST:], True, axis=1)
        return np.nonzero(mine & (found >= floors.astype(np.float64)[:, None]))


def _ask(queries: DataFrame, annuli: Annuli, width: int, k: int, sample_rows: np.ndarray, sample: np.ndarray, first: bool) -> DataFrame:
    """Queries (row, label, v, low) -> a row for each annulus that they expand; `low` is raised to the k-th score of the sample."""
    size = max(1, BOUNDS // max(1, len(annuli.cells), len(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                row, low = batch.column(0).to_numpy(), batch.column(3).to_numpy().copy()
                v = matrix(batch.column(2), width)
                scores = np.where(row[:, None] == sample_rows[None, :], np.iinfo(np.int64).min, products(v, sample))
                if len(sample_rows) > k:
                    low = np.maximum(low, np.partition(scores, len(sample_rows) - k, axis=1)[:, -k])
                query, place = annuli.expand(v, low, first)
                n = len(row)
                columns = {"row": batch.column(0), "label": batch.column(1), "v": batch.column(2)}
                yield from question_rows(columns, query, annuli.cells[place], query, np.zeros(n, dtype=np.int64), low, np.full(n, MOST))

    return queries.select("row", "label", "v", "low").mapInArrow(run, ASKED)


def _top_k_of_width(vectors: DataFrame, width: int, k: int, every: int) -> DataFrame:
    """The results of all queries of one length."""
    vectors = vectors.where(F.size("v") == width)
    n = vectors.count()
    chosen = vectors.withColumn("h", F.xxhash64("vec_id", F.lit(SEED))).orderBy("h", "row").limit(min(SAMPLE, max(PIVOTS, NUMBERS // width)))
    sample = chosen.select("row", "v").toArrow()
    sample_rows, points = sample.column(0).to_numpy(), matrix(sample.column(1).combine_chunks(), width)
    pivots = choose_pivots(points, max(1, min(PIVOTS, n // RING_ROWS)))
    rings = max(1, min(MOST_RINGS, round(n / (len(pivots) * RING_ROWS))))
    index = build_index(vectors, pivots, ring_edges(points, pivots, rings))
    held = index.groupBy("cell").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("largest")).toArrow()  # PIVOTS * MOST_RINGS rows at most
    annuli = Annuli(pivots, *(held.column(c).to_numpy() for c in ("cell", "near", "far", "largest")), rings)
    pages = page_counts(index)
    asked = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v", F.lit(np.iinfo(np.int64).min).alias("low"))
    best = lambda queries, first: best_of_cells(index, pages, _ask(queries, annuli, width, k, sample_rows, points, first), width, k, None)
    near = store(ranked(best(asked, True), k).drop("rank"), "topk-first")
    floor = near.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("least"))  # k rows a query at most
    floor = floor.where(F.col("found") >= k).select(F.col("query").alias("row"), "least")
    raised = asked.join(floor, "row", "left").withColumn("low", F.coalesce("least", "low"))
    found = ranked(near.unionByName(best(raised, False)), k)
    ids = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products over all other rows.

    Queries are the rows whose id is divisible by `every`. Ties go to the smaller vec_id; a
    query with fewer candidates gets all of them. A row with a null id or vector, or with no,
    null or non-finite parts takes no part. Only vectors of one length have a product, so a
    query's candidates are the rows of its own length; each length, of which there are few,
    has an index of its own. Rows that repeat an id or a vector are rows of their own: a
    query's copy is its candidate, and two query rows of one id have a ranking each. An empty
    table gives no rows.
    """
    spark = table.sparkSession
    vectors = store(scaled_vectors(table, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for (width,) in sorted(vectors.select(F.size("v")).distinct().collect()):
        out = out.unionByName(_top_k_of_width(vectors, width, k, every))
    return out
