import math

import numpy as np
import pytest

from propspark.llm import topk, vector_pages
from propspark.llm.topk import choose_pivots, products, top_k


def brute(rows, k=5, every=50):
    """All rows against all query rows, repeats included."""
    vecs = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(vecs):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for m, (c, b) in enumerate(vecs) if m != n and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "sample", "block"), [(4096, 4096, 2048), (3, 16, 8)])
def test_equals_brute_force_with_ties(spark, monkeypatch, chunk, sample, block):
    for name, value in (("BOUNDS", chunk * 20), ("SAMPLE", sample), ("RING_ROWS", block), ("PIVOTS", 8), ("FIRST", 2)):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(vector_pages, "PAGE", block)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(700)]
    rows += [(700 + i, [0.5] * 6) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)


def test_sf_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-0.001, 2.0]), (5, [-0.001, 2.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS v")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows) == [(0, 1, 50, 0), (0, 2, 5, -256), (0, 3, 5, -256), (50, 1, 0, 0), (50, 2, 5, 0), (50, 3, 5, 0)]
    assert top_k(df.limit(0)).count() == 0


def test_repeated_rows_ids_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "RING_ROWS", 3)
    monkeypatch.setattr(topk, "BOUNDS", 60)
    rng = np.random.default_rng(4)
    rows = [(i * 10, rng.normal(size=3).round(2).tolist()) for i in range(60)]
    rows += rows[:7] + [(50, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (50, [0.0, 0.5, 1.0])]  # copies of queries, one id with several vectors
    rows += [(i, [1.0, float(i)]) for i in (100, 101, 102, 150)] + [(200, [1.0]), (3, [])]  # other lengths, one of them alone
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS ring").repartition(4)
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)


def test_only_annuli_that_bounds_reach_are_read(spark, monkeypatch):
    """Vectors in far clusters: queries are shuffled to a part of the annuli only, and the results are whole."""
    monkeypatch.setattr(topk, "RING_ROWS", 40)
    monkeypatch.setattr(topk, "FIRST", 2)
    seen = []
    real = topk.best_of_cells
    monkeypatch.setattr(topk, "best_of_cells", lambda index, pages, asked, *a: seen.append((asked.count(), pages.count())) or real(index, pages, asked, *a))
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 10
    centres *= 40 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.1).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)
    queries = sum(i % 50 == 0 for i, _ in rows)
    cells = seen[0][1]
    assert len(seen) == 2 and cells >= 12 and sum(n for n, _ in seen) < 0.6 * queries * cells


def test_large_numbers_are_exact():
    b = np.array([[2**30 + 1, 2**30 - 1]])
    assert products(b, b)[0, 0] == (2**30 + 1) ** 2 + (2**30 - 1) ** 2
    assert len(choose_pivots(np.ones((5, 2)), 3)) == 1
