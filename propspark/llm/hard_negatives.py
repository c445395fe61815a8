"""Hard negatives by a multiway hyperplane tree with distance ranges.

Vectors get one more coordinate that gives all the same length, so that a score falls as the
distance to a query grows, and a window of scores is an annulus round the query. Each node of
the tree holds a few split points; a vector belongs to the nearest one. Every split point
stores the least and largest distance to the vectors of each of its siblings' subtrees, over
all rows. A query's annulus gives, by the triangle inequality, the distances to a split point
that its answers can have; a sibling whose range does not meet them is eliminated. The leaves
that are left are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import store
from propspark.llm.vector_pages import ASKED, CHUNK, LEAST, MOST, allowed, best_of_cells, exact_products, matrix, page_counts, question_rows, ranked

SEED = 42
#: Rows from which the tree is grown, those whose ids hash lowest, and numbers that they hold at most.
SAMPLE, NUMBERS = 16_384, 1 << 22
#: Rows of the sample that give first bounds of scores.
FLOOR_ROWS = 2048
#: Split points of a node, vectors that a leaf is meant to hold, and rows of the sample for it at least.
SPLITS, LEAF, LEAF_SAMPLE = 8, 1024, 8
#: A sum of squares beyond it could give a product that is no long.
LONGEST = float(1 << 62)


@dataclass
class Tree:
    """Split points and children of each node; a child below 0 is leaf -1 - child. Ranges: node -> (least, largest) by split point and child."""

    radius: float
    points: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    ranges: dict[int, tuple[np.ndarray, np.ndarray]]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes all as long as `radius`."""
        v = v.astype(np.float64)
        return np.column_stack([v, np.sqrt(np.maximum(0, self.radius**2 - (v**2).sum(axis=1)))])

    def descend(self, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, places of the rows in it, their distances to its split points, the child of each)."""
        x, todo = self.lifted(v), [(0, np.arange(len(v)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            d = gaps(x[own], self.points[node])
            nearest = d.argmin(axis=1)
            yield node, own, d, nearest
            todo += [(c, own[nearest == j]) for j, c in enumerate(self.children[node]) if c >= 0]

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), dtype=np.int64)
        for node, own, _, nearest in self.descend(v):
            child = np.array(self.children[node])[nearest]
            out[own[child < 0]] = -1 - child[child < 0]
        return out

    def reached(self, v: np.ndarray, of: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, leaf) of all leaves that may hold an answer; question i asks of vector of[i] for scores from lows[i] to highs[i]."""
        x = np.column_stack([v.astype(np.float64), np.zeros(len(v))])
        square = (x**2).sum(axis=1)[of] + self.radius**2
        far = np.where(lows == LEAST, np.inf, np.sqrt(np.maximum(0, square - 2 * lows.astype(np.float64))))
        near = np.where(highs == MOST, 0, np.sqrt(np.maximum(0, square - 2 * highs.astype(np.float64))))
        slack = 1e-6 * (1 + np.sqrt(square))
        questions, leaves, todo = [], [], [(0, np.flatnonzero(lows <= highs))]
        while todo:
            node, own = todo.pop()
            if not len(own) or node not in self.ranges:
                continue
            least, largest = self.ranges[node]
            d = gaps(x, self.points[node])[of[own]]
            r, s, e = far[own, None], near[own, None], slack[own, None]
            up_to, from_ = d + r + e, np.maximum(d - r, s - d) - e
            alive = ((least[None] <= up_to[:, :, None]) & (largest[None] >= from_[:, :, None])).all(axis=1)
            for j, child in enumerate(self.children[node]):
                kept = own[alive[:, j]]
                if child >= 0:
                    todo.append((child, kept))
                else:
                    questions.append(kept)
                    leaves.append(np.full(len(kept), -1 - child))
        if not questions:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(questions), np.concatenate(leaves)


def gaps(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ points.T + (points**2).sum(axis=1)[None, :]))


def split_points(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of different points, starting at the first one."""
    chosen, far = [0], gaps(x, x[:1])[:, 0]
    while len(chosen) < count and far.max() > 1e-9 * (1 + np.abs(x).max()):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, gaps(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def grow(sample: np.ndarray, radius: float, rows: int) -> Tree:
    """A tree whose leaves hold about LEAF of all rows each, if the sample has LEAF_SAMPLE rows for each of so many."""
    tree = Tree(radius, [], [], 0, {})
    x = tree.lifted(sample)
    enough = max(LEAF_SAMPLE, len(x) * LEAF / max(1, rows))
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        own, parent, place = todo.pop()
        points = split_points(x[own], SPLITS)
        if parent is not None and (len(own) <= enough or len(points) < 2):
            tree.leaves += 1
            tree.children[parent][place] = -tree.leaves
            continue
        node = len(tree.points)
        if parent is not None:
            tree.children[parent][place] = node
        tree.points.append(points)
        tree.children.append([0] * len(points))
        nearest = gaps(x[own], points).argmin(axis=1)
        todo += [(own[nearest == j], node, j) for j in range(len(points))]
    return tree


def measure(index: DataFrame, tree: Tree, width: int) -> None:
    """Sets the tree's ranges from all rows; a task sends one row for each node, split point and child that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for node, _, d, nearest in tree.descend(matrix(batch.column(0), width)):
                m = len(tree.children[node])
                least, largest = held.setdefault(node, (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
                for j in range(m):
                    if (mine := nearest == j).any():
                        least[:, j] = np.minimum(least[:, j], d[mine].min(axis=0))
                        largest[:, j] = np.maximum(largest[:, j], d[mine].max(axis=0))
        for node, (least, largest) in held.items():
            i, j = np.nonzero(least <= largest)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), node)), pa.array(i), pa.array(j), pa.array(least[i, j]), pa.array(largest[i, j])], names=["node", "i", "j", "least", "largest"])

    met = index.select("v").mapInArrow(run, "node long, i long, j long, least double, largest double")
    for r in met.groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("largest").alias("largest")).collect():
        m = len(tree.children[r.node])
        least, largest = tree.ranges.setdefault(r.node, (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
        least[r.i, r.j], largest[r.i, r.j] = r.least, r.largest


def _with_leaf(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(matrix(batch.column(3), width))), *batch.columns], names=["cell", "row", "vec_id", "label", "v"])

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, "cell long, row long, vec_id long, label long, v array<long>")


def _ask(queries: DataFrame, tree: Tree, width: int, k: int, same: bool, sample: tuple[np.ndarray, ...], home: bool | None = None) -> DataFrame:
    """Queries (cell, row, label, v, names, lows, highs) -> a row for each leaf that they must see.

    A question's lowest score is raised to its k-th best of the sample. home: only the query's
    own leaf, or only the others.
    """
    their_rows, their_labels, points = sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                cell, row, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                v = matrix(batch.column(3), width)
                n = np.asarray(batch.column(4).value_lengths())
                of = np.repeat(np.arange(len(row)), n)
                names, lows, highs = (np.array(batch.column(i).flatten(), dtype=np.int64) for i in (4, 5, 6))
                scores = exact_products(v, points)
                for q in range(len(of)):
                    i = of[q]
                    met = scores[i][(their_rows != row[i]) & allowed(their_labels, label[i], same) & (scores[i] >= lows[q]) & (scores[i] <= highs[q])]
                    if len(met) >= k:
                        lows[q] = np.partition(met, len(met) - k)[-k]
                if home:
                    question, leaf = np.arange(len(of)), cell[of]
                else:
                    question, leaf = tree.reached(v, of, lows, highs)
                    if home is False:
                        away = leaf != cell[of[question]]
                        question, leaf = question[away], leaf[away]
                yield from question_rows({"row": batch.column(1), "label": batch.column(2), "v": batch.column(3)}, of[question], leaf, question, names, lows, highs)

    return queries.select("cell", "row", "label", "v", "names", "lows", "highs").mapInArrow(run, ASKED)


def labelled_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): vectors of floor(scale * x) as longs; rows without an id, a label or a whole vector go."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    kept = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound & (square < LONGEST)
    return table.where(kept).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_hard_negatives(
    table: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose id is divisible by `every`; a score is the integer inner product
    of vectors of floor(scale * x). An anchor's positives are its `positives` best rows of the
    same label, itself left out; a pair's negatives the `negatives` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the
    smaller id. Who has fewer gets all; a positive without negatives, as one with a score below
    0, has no rows. Rows with a null id, label or vector, or with an empty vector or null or
    non-finite components, take no part, nor do vectors so long (2^31) that a product is no
    long. Only vectors of one length have a product; each length, of which there are few, has a
    tree of its own. Rows that repeat an id or a vector are rows of their own: they can be each
    other's positives. An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    rows = labelled_vectors(table, scale, id_col, vector_col, label_col)
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    out = spark.createDataFrame([], _RESULT)
    for (width,) in sorted(rows.select(F.size("v")).distinct().collect()):
        out = out.unionByName(_mine(rows.where(F.size("v") == width), width, every, positives, negatives, low, high))
    return out


def _mine(rows: DataFrame, width: int, every: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result over vectors of one length."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most = rows.agg(F.count("*"), F.max(square)).first()
    chosen = rows.withColumn("h", F.xxhash64("vec_id", F.lit(SEED))).orderBy("h", "row").limit(min(SAMPLE, max(SPLITS, NUMBERS // width)))
    sample = chosen.select("row", "label", "v").toArrow()
    their_rows, their_labels = (sample.column(i).to_numpy() for i in range(2))
    points = matrix(sample.column(2).combine_chunks(), width)
    tree = grow(points, float(np.sqrt(most)) * (1 + 1e-9), n)
    some = (their_rows[:FLOOR_ROWS], their_labels[:FLOOR_ROWS], points[:FLOOR_ROWS])
    index = store(_with_leaf(rows, tree, width), "negatives-index")
    measure(index, tree, width)
    pages = page_counts(index)

    def question(name, least, largest) -> list[Column]:
        return [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("names", name), ("lows", least), ("highs", largest))]

    anchors = index.where(F.col("vec_id") % every == 0)
    asked = anchors.select("cell", "row", "label", "v", *question(0, LEAST, MOST))
    near = ranked(best_of_cells(index, pages, _ask(asked, tree, width, positives, True, some, home=True), width, positives, True), positives)
    near = store(near.drop("rank"), "negatives-home")
    floor = near.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("least"))  # at most `positives` rows an anchor
    floor = floor.select(F.col("query").alias("row"), F.when(F.col("found") >= positives, F.col("least")).alias("least"))
    raised = asked.join(floor, "row", "left").withColumn("lows", F.array(F.coalesce("least", F.lit(LEAST)))).drop("least")
    far = best_of_cells(index, pages, _ask(raised, tree, width, positives, True, some, home=False), width, positives, True)
    pairs = store(ranked(near.unionByName(far), positives).select("query", F.col("rank").cast("long").alias("name"), "vec_id", "score"), "negatives-positives")
    # floor(high * score / 100) and, upwards, low * score / 100
    top = F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    bottom = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)")
    windows = pairs.withColumn("low", bottom).withColumn("high", top).where("low <= high")
    windows = windows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("name", "low", "high"))).alias("w"))  # at most `positives` an anchor
    windows = windows.select(F.col("query").alias("row"), F.col("w.name").alias("names"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    asked = anchors.select("cell", "row", "label", "v").join(windows, "row")
    found = best_of_cells(index, pages, _ask(asked, tree, width, negatives, False, some), width, negatives, False)
    found = ranked(found, negatives).select("query", "name", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.select("query", "name", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"))
    return found.join(named, ["query", "name"]).join(ids, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
