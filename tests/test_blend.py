from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
from propspark.functions import odds as O
from propspark.views import view

SF = "/root/testdata/sf0.001"


def fit(x, y, ridge=1e-3):
    b = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ b))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + move
        if np.abs(move).max() < 1e-8:
            break
    return b


def test_blend_fits_on_ninety_days(spark):
    q = view(spark, SF, "quotes").where("book_id IN (1, 2)").withColumn("fair", O.devig("over_odds", "under_odds"))
    days = defaultdict(list)
    for r in q.collect():
        p = np.clip([r.fair, 0.35 + (r.player_id % 31) / 100], 1e-6, 1 - 1e-6)
        days[r.prop_date].append((1.0, *np.log(p / (1 - p)), float(r.actual > r.line)))
    got = defaultdict(list)
    for r in __spark_entry__.queries()["m07_walk_forward_blend"](spark, SF).collect():
        got[r.day].append(r.blend)
    assert got.keys() == days.keys()
    for d, own in days.items():
        past = np.array([row for e, held in days.items() if 1 <= (d - e).days <= 90 for row in held]).reshape(-1, 4)
        if len(past) < 50 or not 0 < past[:, 3].mean() < 1:
            assert got[d] == [None] * len(own)
        else:
            want = 1 / (1 + np.exp(-np.array(own)[:, :3] @ fit(past[:, :3], past[:, 3])))
            assert sorted(got[d]) == pytest.approx(sorted(want), abs=1e-6)
