from datetime import datetime

import pytest
from pyspark.sql import functions as F

from propspark.functions import columns as C
from propspark.functions import odds as O
from propspark.operators import models as M
from propspark.operators import names as N
from propspark.operators import reports as R
from propspark.operators import windows as W
from propspark.sources import io as IO
from propspark.streaming import snapshots as X
from propspark.streaming import state as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_odds_at_the_edges(spark):
    r = one(spark, plus=O.decimal_odds(F.lit(100)), minus=O.decimal_odds(F.lit(-100)), zero=O.decimal_odds(F.lit(0)), none=O.decimal_odds(F.lit(None)), usual=O.decimal_odds(F.lit(None), O.DEFAULT_DECIMAL))
    assert tuple(r) == (2.0, 2.0, None, None, 1.909)
    r = one(spark, a=O.devig(F.lit(-120), F.lit(105)), b=O.devig(F.lit(105), F.lit(-120)))
    assert r.a + r.b == pytest.approx(1)


def test_pushes_and_unknown_results(spark):
    r = one(spark, push=O.outcome(F.lit("under"), F.lit(2), F.lit(2.0)), win=O.outcome(F.lit("under"), F.lit(1), F.lit(2.0)), unknown=O.outcome(F.lit("over"), F.lit(None), F.lit(2.0)))
    assert tuple(r) == ("push", "win", None)
    assert one(spark, p=O.profit(F.lit("push"), F.lit(1.9))).p == 0


def test_unknown_prices_and_chances_stay_unknown(spark):
    none, price = F.lit(None).cast("double"), F.lit(2.0)
    r = one(spark, clamp=O.clamp_odds(none), high=O.clamp_odds(F.lit(200_000)), no_p=O.kelly_fraction(none, price, 0.25, 0.03), no_price=O.kelly_fraction(F.lit(0.9), none, 0.25, 0.03), nothing_won=O.kelly_fraction(F.lit(0.9), F.lit(1.0), 0.25, 0.03), bad=O.kelly_fraction(F.lit(0.4), price, 0.25, 0.03), cap=O.kelly_fraction(F.lit(0.9), price, 0.25, 0.03))
    assert tuple(r) == (None, 99_999, None, None, None, 0.0, 0.03)
    r = one(spark, poisson=O.poisson_tail(none, price), mean=O.poisson_tail(F.lit(1.5), none), nb=O.negative_binomial_tail(none, price, price))
    assert tuple(r) == (None, None, None)


def test_rows_without_a_prediction_have_no_bin_and_no_loss(spark):
    df = spark.createDataFrame([(None, 1), (0.95, 1), (1.0, 1), (0.5, 0)], "p double, y int")
    assert {r.bin: r.n for r in R.calibration(df, "p", "y", 10).collect()} == {None: 1, 9: 2, 5: 1}
    known = R.binary_metrics(df.where("p IS NOT NULL").withColumn("g", F.lit(1)), "p", "y", ["g"]).first()
    assert R.binary_metrics(df.withColumn("g", F.lit(1)), "p", "y", ["g"]).first().log_loss == pytest.approx(known.log_loss)


def test_first_event_has_no_rest(spark):
    df = spark.createDataFrame([(1, datetime(2024, 4, d).date()) for d in (1, 3, 29)], "k int, day date")
    got = [tuple(r) for r in df.select("day", W.rest_days("k", "day", 10).alias("rest"), W.rest_days("k", "day", 10, 7).alias("seven")).orderBy("day").drop("day").collect()]
    assert got == [(None, 7), (2, 2), (10, 10)]


def test_tails(spark):
    r = one(spark, zero=O.poisson_tail(F.lit(0.5), F.lit(2.0)), two=O.poisson_tail(F.lit(2.5), F.lit(2.0)), normal=O.normal_tail(F.lit(1.0), F.lit(1.0), F.lit(2.0)), wins=O.binomial_tail(F.lit(3), F.lit(4), 0.5), nb=O.negative_binomial_tail(F.lit(0.5), F.lit(2.0), F.lit(1e7)))
    assert r.zero == pytest.approx(0.864665, abs=1e-6) and r.two == pytest.approx(0.323324, abs=1e-6)
    assert r.normal == pytest.approx(0.5) and r.wins == pytest.approx(5 / 16) and r.nb == pytest.approx(0.864665, abs=1e-5)


def test_text_columns(spark):
    r = one(spark, ip=C.innings_to_outs(F.lit(6.2)), bad=C.safe_int(F.lit("x")), clock=C.clock_seconds(F.lit("11:05")), tie=C.score_margin(F.lit("TIE")), hand=C.effective_hand(F.lit("S"), F.lit("L")), unknown=C.effective_hand(F.lit("S"), F.lit(None)), low=C.safe_div(F.lit(3), F.lit(9), 10), at=C.safe_div(F.lit(3), F.lit(10), 10))
    assert tuple(r) == (20, None, 665, 0, "R", None, None, 0.3)


def test_names(spark):
    df = spark.createDataFrame([(1, "José  Ramírez Jr."), (2, "jose ramirez"), (3, "O'Neil-Smith III"), (4, None)], "id int, name string").withColumn("norm", N.normalize_name("name"))
    assert [r.norm for r in df.orderBy("id").collect()] == ["jose ramirez", "jose ramirez", "oneilsmith", None]
    left = spark.createDataFrame([("jose ramirez",), ("oneilsmith",)], "norm string")
    assert {r.norm: r.id for r in N.match_unique(left, df, "norm", "id").collect()} == {"jose ramirez": None, "oneilsmith": 3}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, -110, None, None), (2, 100, 105, 1.0)], "id int, price int, closing int, actual double")
    new = spark.createDataFrame([(1, -120, 3.0), (2, None, None), (3, 130, None)], "id int, price int, actual double")
    once = IO.upsert(old, new, ["id"], ["actual"], {"price": "closing"})
    want = [(1, -110, -120, 3.0), (2, 100, 105, 1.0), (3, 130, 130, None)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, IO.upsert(once, new, ["id"], ["actual"], {"price": "closing"}).collect())) == want


def test_append_twice_is_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(path)
    batch = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "id int, v string")
    for _ in range(2):
        IO.append_to(spark, path, batch, ["id"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_partition_overwrite_from_itself(spark, tmp_path):
    path = f"{tmp_path}/p"
    spark.createDataFrame([(1, 2020), (2, 2021)], "v int, season int").write.partitionBy("season").parquet(path)
    IO.overwrite_partitions(spark.read.parquet(path).where("season = 2021").withColumn("v", F.col("v") * 10), path, "season")
    assert sorted((r.v, r.season) for r in spark.read.parquet(path).collect()) == [(1, 2020), (20, 2021)]


def test_streams_equal_batches_with_late_and_repeated_rows(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/state"
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    first = [(1, "a", at(12), -110), (2, "a", at(13), -115), (2, "a", at(13), -115)]
    second = [(3, "a", at(11), -105), (4, "a", at(14), 120), (5, "b", at(14), 100)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "qid int, k string, t timestamp, price int").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = X.stream_snapshots(spark, source, schema, ["qid"], "t", "6 hours", files_per_trigger=1)
    S.use_rocksdb(spark)
    X.run_available(S.latest_prices(stream, ["k"], "t", "qid", "price"), f"{tmp_path}/c", each=S.write_changes(out), mode="update", idle_batches=False)
    got = {r.k: (r.opening, r.closing) for r in S.current(spark.read.parquet(out), ["k"]).collect()}
    assert got == {"a": (-105, 120), "b": (100, 100)}


def test_started_games_are_left_out(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 17), datetime(2024, 1, 1, 18)), (datetime(2024, 1, 1, 18), datetime(2024, 1, 1, 18))], "captured_at timestamp, scheduled_start timestamp")
    assert X.pre_game(df).count() == 1


def test_elo_by_hand(spark):
    rows = [(1, 1, "2024-01-01", 2024, 1, 2, 5, 3), (1, 2, "2025-01-01", 2025, 2, 1, 0, 0)]
    g = spark.createDataFrame(rows, "league int, game_id long, day string, season int, home_team int, away_team int, home_score int, away_score int").withColumn("day", F.to_date("day"))
    a, b = sorted(M.elo(g, "league", ["day"], home_adv=0.0).collect(), key=lambda r: r.game_id)
    move = 6 * 1.0986122886681098 * 0.5
    assert (a.home_elo, a.p_home) == (1500, 0.5)
    assert b.away_elo == pytest.approx(1500 + 0.6 * move) and b.home_elo == pytest.approx(1500 - 0.6 * move)
