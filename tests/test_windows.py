from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propspark.operators import joins as J
from propspark.operators import reports as R
from propspark.operators import windows as W
from propspark.plans import hitting as H

D0 = date(2024, 5, 1)


def day(n):
    return D0 + timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


FACTS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(0, 9)), min_size=1, max_size=25)


@given(FACTS, st.integers(1, 20))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_rolling_days_never_see_the_day_itself(spark, facts, cut):
    def run(rows):
        df = frame(spark, [(k, day(d), v) for k, d, v in rows], "k int, day date, v int")
        daily = W.daily_counts(df, "k", "day", {"v": F.sum("v")})
        return {(r.k, r.day): r.v_7d for r in W.rolling_days(daily, "k", "day", ["v"], 7).collect()}

    got = run(facts)
    for k, d, _ in facts:
        earlier = [v for k2, d2, v in facts if k2 == k and d - 7 <= d2 < d]
        assert got[k, day(d)] == (sum(earlier) if earlier else None)
    later = run([*facts, (0, cut, 100)])
    assert all(later[key] == value for key, value in got.items() if key[1] <= day(cut))


def test_two_rows_of_one_day_and_the_first_day(spark):
    df = frame(spark, [(1, day(0), 2), (1, day(0), 3), (1, day(1), 4)], "k int, day date, v int")
    daily = W.daily_counts(df, "k", "day", {"v": F.sum("v")})
    got = {r.day: r.v_5d for r in W.rolling_days(daily, "k", "day", ["v"], 5).collect()}
    assert got == {day(0): None, day(1): 5}


def test_rolling_rows_respects_min_and_nulls(spark):
    df = frame(spark, [(1, i, v) for i, v in enumerate([1.0, None, 3.0, 5.0])], "k int, o int, v double")
    got = [r.m for r in df.select("o", W.rolling_rows("k", ["o"], "v", 3, "mean", 2).alias("m")).orderBy("o").collect()]
    assert got == [None, None, None, 2.0]


def test_asof_ties_and_null_keys(spark):
    left = frame(spark, [(1, day(3)), (None, day(3)), (2, day(3))], "k int, day date")
    right = frame(spark, [(1, day(3), 10), (1, day(2), 20), (1, day(2), 21), (None, day(1), 30)], "k int, day date, v int")
    at = lambda strict: {r.k: r.v for r in J.asof(left, right, "k", "day", ["v"], strict, "v").collect()}
    assert at(False) == {1: 10, None: None, 2: None}
    assert at(True) == {1: 21, None: None, 2: None}


def test_nearest_at_the_edge(spark):
    left = frame(spark, [(1, "k", "2024-01-01 12:00:00"), (2, "k", "2024-01-01 15:00:00")], "id int, k string, t string").withColumn("t", F.to_timestamp("t"))
    right = frame(spark, [(7, "k", "2024-01-01 12:20:00"), (8, "k", "2024-01-01 11:39:59"), (9, "k", "2024-01-01 15:20:01")], "rid int, k string, t string").withColumn("t", F.to_timestamp("t"))
    got = [(r.id, r.near_rid) for r in J.nearest(left, right, "k", "t", 1200, "id", ["rid"], "rid").collect()]
    assert got == [(1, 7)]


def test_streak_and_gap(spark):
    df = frame(spark, [(1, i, f) for i, f in enumerate([True, True, None, True, False])], "k int, o int, f boolean")
    assert [r.streak for r in W.streak(df, "k", ["o"], "f").orderBy("o").collect()] == [1, 2, 0, 1, 0]
    days = frame(spark, [(1, day(i)) for i in (0, 1, 1, 2, 5)], "k int, day date")
    assert sorted((r.day, r.days_to_gap) for r in W.days_to_gap(days, "k", "day").collect()) == [(day(0), 3), (day(1), 2), (day(2), 1), (day(5), 1)]


def test_mode_and_best_price_ties(spark):
    q = frame(spark, [(1, 1, 2.5, 110), (1, 2, 1.5, 110), (1, 3, 3.5, -105)], "g int, book int, line double, odds int")
    assert R.consensus_line(q, ["g"], "line").first().line == 1.5
    assert R.price_summary(q, ["g"], "odds", "book").first().best_book == 1


def test_auc_of_one_class_is_null(spark):
    df = frame(spark, [("a", 1, 0.2), ("a", 1, 0.9), ("b", 1, 0.9), ("b", 0, 0.9), ("b", 0, 0.1)], "g string, y int, p double")
    got = {r.g: r.auc for r in R.binary_metrics(df, "p", "y", ["g"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.75)


def test_sweep_counts_fall(spark):
    bets = frame(spark, [(day(i), e / 100, "over", "win", 0.9) for i, e in enumerate([-3, 0, 1, 2, 7])], "prop_date date, ev double, side string, result string, profit double")
    counts = [r.n for r in R.threshold_sweep(bets, [-0.05, 0.0, 0.02, 0.05]).orderBy("threshold").collect()]
    assert counts == sorted(counts, reverse=True) == [5, 4, 2, 1]


def test_golden_matchup_row(spark):
    """Right-handed batter against a left-handed starter, worked out by hand."""
    row = {"bats": "R", "throws": "L", "slot": 3, "ip_per_start": 7.4}
    for t in H.PITCH_TYPES:
        share = {"SI": 0.460, "CU": 0.327, "CH": 0.197}.get(t, 0.0)
        row |= {f"pit_share_{t}_R": share, f"pit_share_{t}_L": 0.0, f"bat_xwoba_{t}": {"SI": 0.295, "CU": 0.350, "CH": 0.320}.get(t), f"bat_whiff_{t}": {"SI": 0.18, "CU": 0.30, "CH": 0.28}.get(t)}
    for g in H.PITCH_GROUPS:
        row |= {f"bat_xwoba_{g}": None, f"bat_whiff_{g}": None}
    schema = ", ".join(f"{k} {'string' if k in ('bats', 'throws') else 'int' if k == 'slot' else 'double'}" for k in row)
    r = H.matchup_block(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert r.mu_xwoba == pytest.approx(0.31828, abs=1e-5) and r.mu_whiff == pytest.approx(0.23990, abs=1e-5)
    assert (r.mu_platoon, r.mu_pa) == (1, 4.4)
    assert r.mu_starter_pa == pytest.approx(3.2889, abs=1e-4) and r.mu_bullpen_share == pytest.approx(0.2525, abs=1e-4)


PITCHES = "batter_id int, pitcher_id int, day date, pitch_type string, bats string, throws string, is_swing boolean, is_whiff boolean, is_in_play boolean, zone int, launch_speed double, launch_angle double, xwoba double, release_speed double"
BOX = "batter_id int, day date, pa int, ab int, hits int, doubles int, triples int, hr int, rbi int, bb int, so int"


def some_pitches(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    maybe = lambda v, p=0.05: None if rng.random() < p else v
    rows = []
    for _ in range(n):
        swing, play = bool(rng.random() < 0.5), bool(rng.random() < 0.3)
        rows.append((int(rng.integers(1, 4)), int(rng.integers(10, 13)), day(int(rng.integers(0, 220))), maybe(str(rng.choice(H.PITCH_TYPES))), maybe(str(rng.choice(["L", "R", "S"]))), str(rng.choice(["L", "R"])), maybe(swing), bool(swing and rng.random() < 0.3), play, maybe(int(rng.integers(1, 15))), maybe(float(rng.integers(70, 110))), maybe(float(rng.integers(-20, 60))), maybe(round(float(rng.random()), 3)), maybe(float(rng.integers(85, 100)))))
    box = [(int(b), day(int(d)), int(rng.integers(0, 6)), int(rng.integers(0, 5)), 1, 1, 0, int(rng.integers(0, 2)), 2, 1, 1) for b in (1, 2, 3) for d in range(0, 220, 2) for _ in range(int(rng.integers(1, 3)))]
    return rows, box


def held(rows, key, who, at, n):
    return [r for r in rows if r[key] == who and at - timedelta(days=n) <= r[key_day(rows)] < at]


def key_day(rows):
    return next(i for i, v in enumerate(rows[0]) if isinstance(v, date))


def share(num, den, least):
    return num / den if den >= least else None


def same(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


def test_batter_block_equals_rows(spark):
    """Every rate of some days, counted row by row."""
    rows, box = some_pitches()
    names = [c.split()[0] for c in PITCHES.split(", ")]
    low = dict.fromkeys(H.BATTER_MINIMA, 4)
    p = frame(spark, rows, PITCHES)
    spine = frame(spark, [(b, day(d)) for b in (1, 2, 9) for d in (0, 40, 95, 219, 240)], "batter_id int, day date")
    got = {(r.batter_id, r.day): r for r in H.batter_block(p, frame(spark, box, BOX), spine, low).collect()}
    assert len(got) == 15
    for (b, d), r in got.items():
        mine = [dict(zip(names, x, strict=True)) for x in held(rows, 0, b, d, 90)]
        kinds = {t: [t] for t in H.PITCH_TYPES} | H.PITCH_GROUPS
        for name in (*kinds, "vL", "vR"):
            own = [x for x in mine if (x["throws"] == name[1] if name[0] == "v" else x["pitch_type"] in kinds[name])]
            balls = [x for x in own if x["is_in_play"]]
            assert same(r[f"bat_xwoba_{name}"], share(sum(x["xwoba"] or 0 for x in balls), len(balls), 4))
            swings = [x for x in own if x["is_swing"]]
            assert same(r[f"bat_whiff_{name}"], share(sum(x["is_whiff"] for x in own), len(swings), 4))
        zone = lambda a, z: [x for x in mine if x["zone"] is not None and a <= x["zone"] <= z]  # noqa: B023, E731
        for name, part in (("chase", zone(11, 14)), ("zone_swing", zone(1, 9))):
            assert same(r[f"bat_{name}"], share(sum(bool(x["is_swing"]) for x in part), len(part), 4))
        balls = [x for x in mine if x["is_in_play"]]
        fast, up = lambda x, v: (x["launch_speed"] or 0) >= v, lambda x: x["launch_angle"] if x["launch_angle"] is not None else float("nan")
        for name, f in (("hard_hit", lambda x: fast(x, 95)), ("barrel", lambda x: fast(x, 98) and 26 <= up(x) <= 30), ("gb", lambda x: up(x) < 10), ("ld", lambda x: 10 <= up(x) <= 25), ("fb", lambda x: up(x) > 25)):
            assert same(r[f"bat_{name}"], share(sum(f(x) for x in balls), len(balls), 4))
        swings = sum(bool(x["is_swing"]) for x in mine)
        assert same(r.bat_contact, share(swings - sum(x["is_whiff"] for x in mine), swings, 4))
        form = lambda n: [x for x in held(box, 0, b, d, n) if x[2] > 0]  # noqa: B023, E731
        month, total = form(30), lambda i: sum(x[i] for x in form(30))
        assert same(r.bat_pa_per_game_15d, share(sum(x[2] for x in form(15)), len(form(15)), 4))
        assert same(r.bat_iso_30d, share(total(5) + 2 * total(6) + 3 * total(7), total(3), 4))
        assert same(r.bat_h_plus_rbi_per_pa_30d, share(total(4) + total(8), total(2), 4)) and (month or r.bat_k_rate_30d is None)
    assert sum(r.bat_whiff_vR is not None for r in got.values()) >= 4
    strict = H.batter_block(p, frame(spark, box, BOX), spine).collect()
    assert sum(r.bat_xwoba_FF is None for r in strict) > sum(r.bat_xwoba_FF is None for r in got.values())  # under 20 balls in play of one type


def test_pitcher_block_equals_rows(spark):
    rows, _ = some_pitches(6000, 5)
    names = [c.split()[0] for c in PITCHES.split(", ")]
    low = dict.fromkeys(H.PITCHER_MINIMA, 3)
    spine = frame(spark, [(b, day(d)) for b in (10, 12, 99) for d in (0, 40, 95, 219)], "pitcher_id int, day date")
    got = {(r.pitcher_id, r.day): r for r in H.pitcher_block(frame(spark, rows, PITCHES), spine, low).collect()}
    assert len(got) == 12
    stands = lambda x: x["bats"] if x["bats"] != "S" else "L" if x["throws"] == "R" else "R"
    kinds = {t: [t] for t in H.PITCH_TYPES} | H.PITCH_GROUPS
    for (b, d), r in got.items():
        of = lambda n: [dict(zip(names, x, strict=True)) for x in held(rows, 1, b, d, n)]  # noqa: B023, E731
        month, quarter, half = of(30), of(90), of(180)
        for name, types in kinds.items():
            for h in "LR":
                own = [x for x in month if stands(x) == h]
                assert same(r[f"pit_share_{name}_{h}"], share(sum(x["pitch_type"] in types for x in own), len(own), 3))
            if name in H.PITCH_GROUPS:
                assert same(r[f"pit_share_{name}"], share(sum(x["pitch_type"] in types for x in month), len(month), 3))
                balls = [x for x in quarter if x["pitch_type"] in types and x["is_in_play"]]
                assert same(r[f"pit_xwoba_{name}"], share(sum(x["xwoba"] or 0 for x in balls), len(balls), 3))
        for h in "LR":
            own = [x for x in quarter if stands(x) == h]
            balls = [x for x in own if x["is_in_play"]]
            assert same(r[f"pit_xwoba_{h}"], share(sum(x["xwoba"] or 0 for x in balls), len(balls), 3))
            assert same(r[f"pit_whiff_{h}"], share(sum(x["is_whiff"] for x in own), sum(bool(x["is_swing"]) for x in own), 3))
        assert same(r.pit_whiff, share(sum(x["is_whiff"] for x in quarter), sum(bool(x["is_swing"]) for x in quarter), 3))
        speed = lambda xs: [x["release_speed"] for x in xs if x["pitch_type"] == "FF" and x["release_speed"] is not None]
        velo, base = (share(sum(speed(x)), len(speed(x)), 3) for x in (month, half))
        assert same(r.pit_velo, velo) and same(r.pit_velo_trend, None if velo is None or base is None else velo - base)


@pytest.mark.parametrize("n", [1, 15, 365])
def test_prefix_sums_equal_range_frames(spark, n):
    rng = np.random.default_rng(2)
    rows = sorted({(int(k), day(int(d))): float(v) for k, d, v in zip(rng.integers(0, 3, 300), rng.integers(0, 400, 300), rng.normal(size=300), strict=True)}.items())
    df = frame(spark, [(k, d, v, int(v * 10)) for (k, d), v in rows] + [(0, day(500), None, None)], "k int, day date, x double, c int")
    got = W.prefix_days(df, "k", "day", {n: ["x", "c"], 7: ["x"]})
    want = W.rolling_days(df, "k", "day", ["x", "c"], n)
    a, b = ({(r.k, r.day): (r[f"x_{n}d"] or 0, r[f"c_{n}d"] or 0) for r in f.collect()} for f in (got, want))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a) and f"x_{7}d" in got.columns


def test_batter_block_has_no_leak(spark):
    def run(extra):
        rows = [(1, 10, day(i), "FF", "L", "R", True, i % 3 == 0, True, 5, 99.0, 28.0, 0.3, 95.0) for i in range(10) for _ in range(6)] + extra
        p = frame(spark, rows, PITCHES)
        box = frame(spark, [(1, day(i), 4, 4, 1, 0, 0, 0, 1, 1, 1) for i in range(10)], BOX)
        return {r.day: r for r in H.batter_block(p, box, p.select("batter_id", "day").distinct()).collect()}

    before, after = run([]), run([(1, 10, day(6), "FF", "L", "R", True, True, False, 12, None, None, None, None)] * 5)
    assert len(before) == 10 and before[day(0)].bat_whiff_FF is None and before[day(4)].bat_xwoba_FF == pytest.approx(0.3)
    assert all(before[d] == after[d] for d in before if d <= day(6)) and before[day(7)] != after[day(7)]


def test_expanding_exact_mean(spark):
    """The sum of the values as they print, rounded once; values that no decimal holds, and sums that outgrow it, are added as doubles."""
    rng = np.random.default_rng(3)
    rates = [None if i % 17 == 5 else float(x) for i, x in enumerate(rng.integers(-400, 400, 500) / 360)]
    odd = {2: [0.25, 0.5, float("nan"), 1.0], 3: [0.25, float("-inf"), 1.0, 2.0], 4: [6e17, 6e17, 6e17, -6e17, 0.5], 5: [1e19, 1.5, None, 2.5], 6: [None, None, 0.0]}
    rows = [(k, i, x) for k, xs in ({1: rates} | odd).items() for i, x in enumerate(xs)]
    df = frame(spark, rows, "k int, i int, x double")
    got = {(r.k, r.i): r.m for r in df.withColumn("m", W.expanding_exact_mean("k", ["i"], "x", 2)).collect()}
    assert len(got) == len(rows)
    for k, i, _ in rows:
        held = [x for k2, i2, x in rows if k2 == k and i2 < i and x is not None]
        if len(held) < 2:
            assert got[k, i] is None
        elif k == 1:
            assert got[k, i] == float(sum(round(Decimal(repr(x)), 20) for x in held)) / len(held)
        else:
            assert got[k, i] == pytest.approx(sum(held) / len(held), rel=1e-15, nan_ok=True)
