"""Exact scores of queries over the cells of a vector index, as one Spark job.

An index puts every vector in a cell; each query names the cells that it must see and a
window of scores for each of its questions. Cells are cut into pages of a bounded size, so a
hot cell is spread over tasks. Pages and the queries that ask for them are shuffled to one
place and sorted so that a page's vectors come first and its queries stream past them: a task
holds one page and one batch of queries at a time, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a page is meant to hold, and queries that are scored at once.
PAGE, CHUNK = 2048, 256
#: Largest sum that float64 arithmetic holds exactly.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1

STREAM = ["cell", "page", "kind", "row", "vec_id", "label", "v", "names", "lows", "highs"]
FOUND = "query long, name long, row long, vec_id long, score long"


def matrix(column, width: int) -> np.ndarray:
    """A list column of one length as a matrix of longs."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b.T: in floating point where every partial sum is exact, else in integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, then row."""
    return np.lexsort((rows, ids, -scores))[:k]


def allowed(labels: np.ndarray, label: int, same: bool | None) -> np.ndarray | bool:
    """Which vectors a query of `label` may find: those of its label, of others, or all."""
    return True if same is None else labels == label if same else labels != label


def _score(width: int, k: int, same: bool | None):
    """A sorted stream of pages and queries -> each query's k best of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, ids, labels, points = None, [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, page, kind, row, vec_id, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            v = matrix(batch.column(6), width)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(page) != 0) | (np.diff(kind) != 0)) + 1
            out: list[tuple] = []
            for part in np.split(np.arange(batch.num_rows), cuts):
                a, z = part[0], part[-1] + 1
                if place != (cell[a], page[a]):
                    place, rows, ids, labels, points = (cell[a], page[a]), [], [], [], []
                if kind[a] == 0:
                    for held, new in ((rows, row), (ids, vec_id), (labels, label), (points, v)):
                        held.append(new[a:z])
                    continue
                if len(rows) > 1:
                    rows, ids, labels, points = ([np.concatenate(x)] for x in (rows, ids, labels, points))
                if not rows:
                    continue
                for at in range(a, z, CHUNK):
                    end = min(z, at + CHUNK)
                    scores = exact_products(v[at:end], points[0])
                    names, lows, highs = (batch.column(i).slice(at, end - at).to_pylist() for i in (7, 8, 9))
                    for i in range(end - at):
                        free = (rows[0] != row[at + i]) & allowed(labels[0], label[at + i], same)
                        for name, low, high in zip(names[i], lows[i], highs[i], strict=True):
                            hit = np.flatnonzero(free & (scores[i] >= low) & (scores[i] <= high))
                            if len(hit):
                                own = hit[best(scores[i][hit], ids[0][hit], rows[0][hit], k)]
                                n = len(own)
                                out.append((np.full(n, row[at + i]), np.full(n, name), rows[0][own], ids[0][own], scores[i][own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def page_counts(index: DataFrame) -> DataFrame:
    """(cell, pages): one row for each cell that holds vectors."""
    return index.groupBy("cell").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages"))


def best_of_cells(index: DataFrame, pages: DataFrame, asked: DataFrame, width: int, k: int, same: bool | None) -> DataFrame:
    """(query, name, row, vec_id, score): each question's k best of every page of the cells that it asks for.

    index: (cell, row, vec_id, label, v); asked: (cell, row, label, v, names, lows, highs),
    a row for each query and cell, with a window of scores for each of its questions.
    `pages` is as long as there are cells, a number that the index bounds.
    """
    nothing = F.array().cast("array<long>")
    number = F.pmod(F.xxhash64("row"), F.col("pages")).cast("long")
    data = index.join(F.broadcast(pages), "cell")
    data = data.select("cell", number.alias("page"), F.lit(0).alias("kind"), "row", "vec_id", "label", "v", nothing.alias("names"), nothing.alias("lows"), nothing.alias("highs"))
    to_pages = asked.join(F.broadcast(pages), "cell").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages").cast("long") - 1)))
    to_pages = to_pages.select("cell", "page", F.lit(1).alias("kind"), "row", F.lit(0).cast("long").alias("vec_id"), "label", "v", "names", "lows", "highs")
    stream = data.unionByName(to_pages).select(*STREAM)
    return stream.repartition("cell", "page").sortWithinPartitions("cell", "page", "kind", "row").mapInArrow(_score(width, k, same), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """`found` with rank from 1, the k first of every question."""
    order = Window.partitionBy("query", "name").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def question_rows(columns: dict[str, pa.Array], query: np.ndarray, cell: np.ndarray, question: np.ndarray, names, lows, highs) -> Iterator[pa.RecordBatch]:
    """Batches of `asked`: pairs of query and question for each cell, gathered by query and cell.

    columns: row, label and v of the queries; query, cell and question are places, a pair each.
    """
    order = np.lexsort((question, cell, query))
    query, cell, question = query[order], cell[order], question[order]
    first = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
    ends = np.append(first[1:], len(query))
    for a in range(0, len(first), 4096):
        some, z = first[a : a + 4096], ends[a : a + 4096]
        where = slice(some[0], z[-1])
        at = pa.array(np.append(some, z[-1]) - some[0], pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x[question[where]])) for x in (names, lows, highs)]
        taken = pa.array(query[some])
        yield pa.RecordBatch.from_arrays([pa.array(cell[some]), *[columns[c].take(taken) for c in ("row", "label", "v")], *lists], names=["cell", "row", "label", "v", "names", "lows", "highs"])


ASKED = "cell long, row long, label long, v array<long>, names array<long>, lows array<long>, highs array<long>"
