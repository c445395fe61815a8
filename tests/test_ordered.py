import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propspark.operators import ordered as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 3000
    p = pd.DataFrame({"k": np.where(np.arange(n) < 2500, "hot", rng.choice(["a", "b", None], n)), "t": rng.permutation(n), "x": rng.normal(size=n).round(3)})
    p.loc[rng.random(n) < 0.1, "x"] = np.nan
    return p, spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("k", F.when(F.col("k") != "NaN", F.col("k"))).repartition(5)


@pytest.mark.parametrize("rows", [100, 1_000_000])
def test_running_values_equal_pandas(spark, table, rows):
    p, df = table
    cut = R.chunked(df, ["k"], ["t"], rows)
    assert rows > 3000 or cut.where("k = 'hot'").select("_chunk").distinct().count() > 10  # one key, many tasks
    made = {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "at": ("last", F.when(F.col("x") > 1, F.col("t"))), "no": ("sum", F.lit(1))}
    for before in (False, True):
        got = R.running(cut, ["k"], ["t"], made, before).toPandas().sort_values("t").reset_index(drop=True)
        q = p.sort_values("t").reset_index(drop=True)
        g = q.assign(k=q.k.fillna("-"), big=q.t.where(q.x > 1), one=1.0).groupby("k")
        move = (lambda s: s.groupby(q.k.fillna("-")).shift(1)) if before else (lambda s: s)
        want = {"s": move(g["x"].transform(lambda s: s.cumsum().ffill())), "hi": move(g["x"].transform(lambda s: s.cummax().ffill())), "lo": move(g["x"].transform(lambda s: s.cummin().ffill())), "at": move(g["big"].transform("ffill")), "no": move(g["one"].cumsum())}
        for c, w in want.items():
            np.testing.assert_allclose(got[c].astype(float), w.astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize(("n", "rows"), [(1, 50), (7, 50), (60, 50), (200, 1_000_000)])
def test_trailing_rows_equal_pandas(spark, table, n, rows):
    p, df = table
    made = {"m": lambda w: F.when(F.count("x").over(w) >= 3, F.avg("x").over(w)), "top": lambda w: F.max("x").over(w)}
    got = R.trailing_rows(df, ["k"], ["t"], n, made, rows).toPandas().sort_values("t").reset_index(drop=True)
    q = p.sort_values("t").reset_index(drop=True)
    roll = q.assign(k=q.k.fillna("-")).groupby("k")["x"]
    np.testing.assert_allclose(got.m.astype(float), roll.transform(lambda s: s.rolling(n, min_periods=3 if n > 2 else n).mean() if n > 2 else s * np.nan).astype(float), atol=1e-9)
    np.testing.assert_allclose(got.top.astype(float), roll.transform(lambda s: s.rolling(n, min_periods=1).max()).astype(float))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    sets = {"even": rng.normal(size=4001), "ties": rng.integers(0, 5, 3000).astype(float), "wide": np.concatenate([rng.normal(size=999) * 1e-9, [1e300, -1e300]]), "one": np.array([3.5]), "same": np.full(40, 2.0), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("even", None), ("none", None), ("even", float("nan")), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = R.order_statistics(df, ["g"], "v", shares, bins=16)
    assert set(got) == {*((k,) for k in sets), (None,)}
    for k, vs in sets.items():
        np.testing.assert_allclose(got[(k,)], np.quantile(vs, shares), rtol=1e-12)
    assert R.order_statistics(df.limit(0), [], "v", [0.5]) == {}
    assert R.order_statistics(df.where("g = 'two'"), [], "v", [0.5]) == {(): [1.5]}


@pytest.mark.parametrize("seconds", [5, 60])
def test_nearest_equals_all_pairs(spark, seconds):
    from propspark.operators.joins import nearest

    rng = np.random.default_rng(6)
    side = lambda n, m: [(int(i), ("a" if i % 3 else "b") if i % 17 else None, int(t)) for i, t in enumerate(rng.integers(0, m, n))]
    left, right = side(300, 900), side(200, 900)
    right += [(1000, "a", None), (1001, "c", 5)]
    df = lambda rows: spark.createDataFrame(rows, "id long, k string, s int").selectExpr("id", "k", "timestamp_seconds(s) AS at").repartition(3)
    got = nearest(df(left), df(right), "k", "at", seconds, "id", ["id"], "id")
    want = {}
    for i, k, t in left:
        near = sorted((abs(t - u), j) for j, q, u in right if k is not None and q == k and u is not None and abs(t - u) <= seconds)
        if near:
            want[i] = (near[0][1], float(near[0][0]))
    assert {r.id: (r.near_id, r.gap_seconds) for r in got.collect()} == want and len(want) > 50
    assert got.columns == ["id", "k", "at", "near_id", "gap_seconds"]


def test_auc_of_one_group_is_spread_and_exact(spark, monkeypatch):
    from propspark.operators.reports import binary_metrics

    monkeypatch.setattr(R.chunked, "__defaults__", (50,))
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 1500), rng.random(1500).round(2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p, "g": 1})).repartition(4)
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    want = ((a > b) + 0.5 * (a == b)).mean()
    out = binary_metrics(df, "p", "y", ["g"])
    assert abs(out.first().auc - want) < 1e-12


def test_long_paths_and_runs_of_one_group(spark, monkeypatch):
    from propspark.operators.reports import kelly_path
    from propspark.operators.windows import streak_stats

    rng = np.random.default_rng(5)
    won = rng.random(2000) < 0.5
    won[700:760] = True
    won[1200:1235] = False
    profit = np.where(won, 0.9, -1.0)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": np.arange(2000), "r": np.where(won, "win", "loss"), "profit": profit, "f": 0.02})).repartition(4)
    monkeypatch.setattr(R.chunked, "__defaults__", (50,))
    monkeypatch.setattr(R.numbered, "__defaults__", ("row_no", 50))
    got = streak_stats(df, ["g"], ["t"], "r", "profit", 1000.0).first()
    runs = {}
    length = 0
    for i, w in enumerate(won):
        length = length + 1 if i and w == won[i - 1] else 1
        runs[bool(w)] = max(runs.get(bool(w), 0), length)
    bank = 1000 + np.cumsum(profit)
    assert (got.longest_win, got.longest_loss) == (runs[True], runs[False])
    assert got.worst_fall == pytest.approx((bank / np.maximum(1000, np.maximum.accumulate(bank)) - 1).min())
    path = kelly_path(df, ["g"], ["t"], "f", "profit").first()
    log = np.cumsum(np.log(1 + 0.02 * profit))
    assert path.final == pytest.approx(np.exp(log[-1])) and path.n == 2000
    assert path.worst_fall == pytest.approx((np.exp(log - np.maximum(0, np.maximum.accumulate(log))) - 1).min())


def test_bucketed_facts_join_without_a_shuffle(spark, tmp_path):
    from propspark.operators.joins import join_companion
    from propspark.sources import io as IO

    a = spark.range(1000).selectExpr("id % 300 AS k", "id AS x")
    b = spark.range(300).selectExpr("id AS k", "id * 2 AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [IO.save_bucketed(df, f"bucketed_{n}", f"{tmp_path}/{n}", ["k"], 4) for n, df in (("a", a), ("b", b))]
        out = join_companion(*tables, ["k"]).groupBy("k", "x").agg(F.sum("y").alias("y"))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == sorted((i % 300, i, i % 300 * 2) for i in range(1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
