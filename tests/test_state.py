import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from propspark.streaming import snapshots as X
from propspark.streaming import state as S

BETS = "bet_id long, player_id long, day date, line double, side string, payout double, at timestamp"
BOX = "row_id long, player_id long, day date, hits long, walks long, at timestamp"
DAY = dt.date(2024, 5, 1)
NOON = dt.datetime(2024, 5, 1, 12)


def hours(n):
    return NOON + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def feed():
    """Player 1 plays twice on the first day (a doubleheader); 2 has one game a day; 3 has bets and no score."""
    bets = [(i, p, DAY + dt.timedelta(days=d), line, side, 1.9, hours(24 * d - 2)) for i, (p, d, line, side) in enumerate([(1, 0, 1.5, "over"), (1, 0, 2.0, "over"), (1, 0, 3.5, "under"), (2, 0, 0.5, "under"), (2, 1, 1.5, "over"), (3, 0, 0.5, "over")])]
    box = [(1, 1, DAY, 1, 0, hours(3)), (2, 1, DAY, 0, 1, hours(8)), (3, 2, DAY, 0, 0, hours(4)), (4, 2, DAY + dt.timedelta(days=1), 2, 0, hours(28))]
    return bets, box


def run(spark, folder, steps):
    """Each step writes files of (kind, rows) and lets the stream take all that is there; one checkpoint for all."""
    schemas = {"bets": BETS, "box": BOX, "clock": "at timestamp"}
    for kind in schemas:
        os.makedirs(f"{folder}/{kind}", exist_ok=True)
    S.use_rocksdb(spark)
    for step in steps:
        for kind, rows in step:
            spark.createDataFrame(rows, schemas[kind]).coalesce(1).write.mode("append").parquet(f"{folder}/{kind}")
        read = {k: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{k}") for k, s in schemas.items()}
        closes = F.date_add("day", 1)
        out = S.settle_stream(read["bets"], read["box"], ["player_id", "day"], ["hits", "walks"], "line", "side", "payout", ("bet_id", "row_id"), "at", closes, "6 hours", read["clock"])
        X.run_available(out, f"{folder}/state", f"{folder}/out")
    got = spark.read.parquet(f"{folder}/out").collect()
    return sorted(((r.bet_id, r.actual, r.result, r.profit) for r in got), key=lambda r: (r[0], str(r)))


def by_batch(spark, bets, box):
    b, x = spark.createDataFrame(bets, BETS), spark.createDataFrame(box, BOX)
    out = X.settle(b, x, ["player_id", "day"], ["hits", "walks"], "line", "side", "payout")
    return sorted((r.bet_id, r.actual, r.result, r.profit) for r in out.collect())


END = [("clock", [(hours(24 * 5),)])]


def test_split_doubleheader_settles_once_on_the_whole_sum(spark, tmp_path, feed):
    bets, box = feed
    want = by_batch(spark, bets, box)
    steps = [[("bets", bets[:3]), ("box", box[:1])], [("bets", bets[3:]), ("box", box[1:])], END]
    assert run(spark, tmp_path, steps) == want
    assert dict((w[0], w[2]) for w in want) == {0: "win", 1: "push", 2: "win", 3: "win", 4: "win", 5: None}


def test_replays_and_late_rows_change_nothing(spark, tmp_path, feed):
    """All rows come again in other batches, some within the delay and some after their day was settled; a box row comes late, within the delay."""
    bets, box = feed
    late = (5, 2, DAY, 0, 1, hours(5))  # an earlier hour than what came before it
    steps = [[("bets", [*bets[:4], bets[5]]), ("box", [box[1], box[2]])], [("box", [box[1], late]), ("bets", bets[:2])], [("box", [box[0]])], [("bets", [bets[4]]), ("box", [box[3]])]]
    first = run(spark, tmp_path, [*steps, END])
    assert first == by_batch(spark, bets, [*box, late])
    assert run(spark, tmp_path, [[("bets", bets), ("box", box)], END]) == first


def test_a_day_waits_until_it_closes(spark, tmp_path, feed):
    bets, box = feed
    assert run(spark, tmp_path, [[("bets", bets[:1]), ("box", box[:2])]]) == []
    assert [r[0] for r in run(spark, tmp_path, [END])] == [0]


QUOTES = "quote_id long, prop_id long, source string, price int, at timestamp"


def test_latest_prices_follow_the_batches(spark, tmp_path):
    rows = [(1, 7, "a", -110, hours(0)), (2, 7, "a", -105, hours(1)), (3, 7, "b", 120, hours(0)), (4, 8, "a", None, hours(2)), (5, 7, "a", -120, hours(-1)), (6, 7, "a", -101, hours(1)), (7, 9, "a", 100, None)]
    os.makedirs(f"{tmp_path}/in")
    S.use_rocksdb(spark)
    written = []
    for step in ([rows[0], rows[2], rows[3]], [rows[1], rows[4]], [rows[5], rows[1]], [rows[2]]):  # the last two bring repeats
        spark.createDataFrame(step, QUOTES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(QUOTES).parquet(f"{tmp_path}/in")
        X.run_available(S.latest_prices(stream, ["prop_id", "source"], "at", "quote_id", "price"), f"{tmp_path}/state", each=S.write_changes(f"{tmp_path}/out"), mode="update", idle_batches=False)
        changes = spark.read.parquet(f"{tmp_path}/out")
        written.append(changes.where(F.col("batch") == changes.agg(F.max("batch")).first()[0]).count())
    assert written == [3, 1, 1, 1]  # a batch writes the keys that it brought
    got = {(r.prop_id, r.source): (r.opening, r.closing) for r in S.current(changes, ["prop_id", "source"]).collect()}
    assert got == {(7, "a"): (-120, -101), (7, "b"): (120, 120), (8, "a"): (None, None)}


def test_nearest_quotes_whatever_the_batches(spark, tmp_path):
    """Every sharp quote meets its nearest soft one, which may come before it, behind it, in another batch or late within the delay."""
    minute = lambda m: NOON + dt.timedelta(minutes=m)
    sharp = [(1, 7, minute(0)), (2, 7, minute(30)), (3, 8, minute(5)), (4, 7, minute(95))]
    soft = [(11, 7, minute(-19)), (12, 7, minute(10)), (13, 7, minute(20)), (14, 7, minute(40)), (15, 8, minute(30)), (16, 7, minute(96)), (17, 7, minute(94))]
    os.makedirs(f"{tmp_path}/sharp"), os.makedirs(f"{tmp_path}/soft"), os.makedirs(f"{tmp_path}/clock")
    schema = "id long, k long, at timestamp"
    S.use_rocksdb(spark)
    late = soft[1]
    for a, b, c in ((sharp[:2], [soft[0], soft[3]], []), (sharp[2:3], [late, soft[2]], []), (sharp[3:], soft[4:], []), ([], [], [(0, None, minute(6000))])):
        for name, rows in (("sharp", a), ("soft", b), ("clock", c)):
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        read = lambda n: spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}")
        X.run_available(S.nearest_stream(read("sharp"), read("soft"), ["k"], "at", "id", 20, "1 hour", read("clock")), f"{tmp_path}/state", f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(7, 1, 12), (7, 2, 13), (7, 4, 16)]


def steps_of(df):
    return df._jdf.queryExecution().logical().toString()


def test_settlement_runs_no_python_per_key(spark, tmp_path):
    for name in ("bets", "box"):
        os.makedirs(f"{tmp_path}/{name}")
    read = lambda n, s: spark.readStream.schema(s).parquet(f"{tmp_path}/{n}")
    out = S.settle_stream(read("bets", BETS), read("box", BOX), ["player_id", "day"], ["hits", "walks"], "line", "side", "payout", ("bet_id", "row_id"), "at", F.date_add("day", 1), "6 hours")
    assert "Aggregate" in steps_of(out) and not any(n in steps_of(out) for n in ("Python", "Pandas", "TransformWithState"))


def test_nearest_quotes_come_once_and_run_no_python_per_key(spark, tmp_path):
    """Quotes that come twice before their slot closes are one; equal times take the smaller id; neighbours may lie in other slots."""
    schema = "id long, k long, at timestamp"
    hour = NOON.replace(minute=0)
    minute = lambda m: hour + dt.timedelta(minutes=m)
    sharp = [(i, 7, minute(7 * i)) for i in range(1, 40)]
    soft = [(100 + i, 7, minute(11 * (i // 2) + 1)) for i in range(40)] + [(99, 7, None)]
    rows = {"sharp": sharp * 2, "soft": soft * 2, "clock": [(0, None, minute(6000))]}
    S.use_rocksdb(spark)
    for name in rows:
        os.makedirs(f"{tmp_path}/{name}")
    for name in ("sharp", "soft", "clock"):
        spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        if name != "sharp":
            read = lambda n: spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}")
            out = S.nearest_stream(read("sharp"), read("soft"), ["k"], "at", "id", 20, "1 hour", read("clock"))
            X.run_available(out, f"{tmp_path}/state", f"{tmp_path}/out")
    known = [(j, u) for j, _, u in soft if u]
    want = []
    for i, k, t in sharp:
        gap, j = min((abs(u - t), j) for j, u in known)
        if gap <= dt.timedelta(minutes=20):
            want.append((k, i, j))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    assert "TransformWithState" not in steps_of(out)
