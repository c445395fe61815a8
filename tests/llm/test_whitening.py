import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from propspark.llm import whitening
from propspark.llm.whitening import by_component, whiten


def brute(rows, components=16):
    """Per row (in given order) its length, n, exact deviation and whitened values up to sign, by numpy on one machine."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for width in {len(x) for _, x in kept}:
        own = [(i, x) for i, x in kept if len(x) == width]
        fit = sorted({tuple(x) for _, x in own})
        n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centre = lambda x: [float(Fraction(n * a - s, n)) for a, s in zip(x, total, strict=True)]  # noqa: B023, E731
        c = np.array([centre(x) for x in fit])
        e, w = np.linalg.eigh(c.T @ c / n)
        e, w = e[::-1], w[:, ::-1]
        for i, x in own:
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
            out.append((i, width, n, deviation, [abs(float(np.dot(centre(x), w[:, k]))) / math.sqrt(e[k]) if e[k] > 1e-12 * e.sum() else None for k in range(min(width, components))], [v / e.sum() if e.sum() > 0 else None for v in e[:components]]))
    return out


def close(a, b, tolerance=1e-8):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= tolerance * max(1, abs(b)))


def same(got, want):
    """Both lists hold the same rows; vectors are told by id, length and deviation."""
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted([(r.vec_id, r.dimensions, r.n, int(r.deviation_exact), r.whitened, r.explained) for r in got], key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert all(close(a if a is None else abs(a), b) for a, b in zip(g[4], w[4], strict=True)), (g, w)
        assert all(close(a, b) for a, b in zip(g[5], w[5], strict=True))


@pytest.mark.parametrize(("rows_a_block", "cols_a_block"), [(1024, 1024), (37, 5)])
def test_equals_brute_force_on_given_vectors(spark, monkeypatch, rows_a_block, cols_a_block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(whitening, "BLOCK_COLS", cols_a_block)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whiten(df.repartition(5)).collect()
    same(got, brute([(r.vec_id, r.embedding) for r in df.collect()]))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert all(r.deviation == r.deviation_exact for r in got)


def test_rows_by_component_share_their_signs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = by_component(whiten(df)).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.component][r.vec_id] = r.whitened
    assert sorted(by) == list(range(1, 17))
    a = np.array([[by[c][i] for i in sorted(by[c])] for c in sorted(by)])
    assert np.abs(a @ a.T / a.shape[1] - np.eye(16)).max() < 1e-9  # distinct vectors here: one sign and scale for all rows
    shares = [next(r.explained for r in rows if r.component == c) for c in sorted(by)]
    assert shares == sorted(shares, reverse=True)


def test_copies_count_once_and_come_back_each(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(1000 + i, [3.0, 1.0, -2.0, 0.5]) for i in range(500)] + rows[:5] + [(None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS x", "3 AS at", "4 AS n").repartition(6)
    got = whiten(df).collect()
    assert {r.n for r in got} == {62}
    same(got, brute(rows))


def test_odd_rows_lengths_and_flat_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = [(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0])]
    rows += [(10 + i, [float(a), 2.0 * a, 7.0]) for i, a in enumerate(rng.integers(-30, 30, 40).tolist())]  # one component varies, two do not
    rows += [(100 + i, rng.normal(size=2).tolist()) for i in range(30)] + [(200, [5.0])] * 2  # other lengths, one without any variance
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(df, components=3).collect()
    same(got, brute(rows, 3))
    lone = [r for r in got if r.dimensions == 1]
    assert len(lone) == 2 and all(r.whitened == [None] and r.explained == [None] and r.identity_error is None and r.deviation == 0 for r in lone)
    assert all(r.whitened[1:] == [None, None] for r in got if r.dimensions == 3)
    assert whiten(df.limit(0)).collect() == [] and by_component(whiten(df.limit(0))).collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float((-1) ** i * i * 2**18), float(i % 7), 2.0**29 - i * i]) for i in range(300)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {r[0]: r[3] for r in brute(rows)}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want and max(want.values()) >= 2**63
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in got)


def test_too_long_vectors_raise(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 3)
    with pytest.raises(ValueError, match="limit is 3"):
        whiten(spark.createDataFrame([(1, [1.0] * 4)], "vec_id long, embedding array<double>"))
