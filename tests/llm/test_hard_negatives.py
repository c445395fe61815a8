import math

import numpy as np
import pytest

from propspark.llm import hard_negatives, vector_pages
from propspark.llm.hard_negatives import Tree, grow, mine_hard_negatives
from propspark.llm.vector_pages import LEAST, MOST


def brute(rows, every=100, positives=5, negatives=10):
    """All rows against all anchors, repeats included."""
    vecs = [(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, label, v) in enumerate(vecs):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), c, m, other) for m, (c, other, w) in enumerate(vecs) if m != n and len(v) == len(w)]
        for p in sorted(s for s in scored if s[3] == label)[:positives]:
            kept = sorted(s for s in scored if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:negatives]
            out += [(a, p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(kept)]
    return sorted(out)


def mined(df, **given):
    return sorted(map(tuple, mine_hard_negatives(df, **given).collect()))


@pytest.mark.parametrize(("leaf", "page", "chunk", "sample"), [(1024, 2048, 256, 16_384), (20, 7, 3, 200)])
def test_equals_brute_force_with_ties(spark, monkeypatch, leaf, page, chunk, sample):
    monkeypatch.setattr(vector_pages, "PAGE", page)
    for name, value in (("LEAF", leaf), ("CHUNK", chunk), ("SAMPLE", sample), ("FLOOR_ROWS", sample // 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(vector_pages, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(400)]  # a hot vector of two labels
    rows += [(2000 + i, [0.4, 0.4, 0.5, 0.3, 0.4, 0.4], 2) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert mined(df) == brute(rows)
    assert mined(df, every=50, positives=2, negatives=3) == brute(rows, 50, 2, 3)


def test_given_vectors_in_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 40)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert mined(df) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 1.0], 1), (5, [0.9, 0.1], None), (None, [1.0, 1.0], 1)]
    rows += [(6, [0.9, 0.1], 1), (6, [0.9, 0.1], 1), (7, [0.5, 0.5], 2), (7, [0.5, 0.5], 2), (8, [-1.0, 0.0], 1), (100, [0.0, 0.0], 3), (0, [1.0, 0.0], 1)]
    rows += [(200, [1.0], 1), (201, [1.0], 1), (202, [0.5], 2), (300, [1.0, 2.0, 3.0], 1), (9, [], 1), (10, [1e300, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS row", "2 AS cell", "3 AS score")
    assert mined(df) == brute([r for r in rows if r[0] != 10])
    assert mined(df.limit(0)) == []


def test_ranges_eliminate_siblings_and_lose_nothing(spark):
    """Vectors in far clusters: an annulus reaches a few leaves, and they hold every answer."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(16, 8)) * 3000
    v = np.floor(centres[np.arange(3200) % 16] + rng.normal(size=(3200, 8)) * 20).astype(np.int64)
    tree = grow(v[:800], float(np.sqrt((v.astype(float) ** 2).sum(axis=1).max())) * (1 + 1e-9), 3200 * 16)
    index = spark.createDataFrame([(r.tolist(),) for r in v], "v array<long>").repartition(3)
    hard_negatives.measure(index, tree, 8)
    leaf = tree.leaf_of(v)
    asked = v[:64]
    scores = asked @ v.T
    lows, highs = np.sort(scores, axis=1)[:, -12], np.full(64, MOST)
    for low, high in ((lows, highs), (np.sort(scores, axis=1)[:, 1000], np.sort(scores, axis=1)[:, 1050]), (np.full(64, LEAST), highs)):
        question, found = tree.reached(asked, np.arange(64), low, high)
        held = {(q, n) for q, n in zip(question.tolist(), found.tolist(), strict=True)}
        assert len(held) == len(question)
        for q in range(64):
            hits = np.flatnonzero((scores[q] >= low[q]) & (scores[q] <= high[q]))
            assert all((q, n) in held for n in leaf[hits])
    question, found = tree.reached(asked, np.arange(64), lows, highs)
    read = sum((leaf == n).sum() for n in found)
    assert tree.leaves >= 16 and read < 0.3 * 64 * len(v)


def test_growing_handles_equal_and_few_points():
    for sample in (np.ones((50, 3), dtype=np.int64), np.ones((1, 3), dtype=np.int64), np.zeros((4, 2), dtype=np.int64)):
        tree = grow(sample, 2.0, 10_000)
        assert isinstance(tree, Tree) and tree.leaves >= 1 and set(tree.leaf_of(sample)) == {0}
