import datetime as dt

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_scheduled_games_behind_played_ones_of_their_id(spark, tmp_path):
    """Every scheduled game has the id, team and day of a played one, which comes first."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(400).selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS DATE) AS o_orderdate")
    later = orders.selectExpr("o_orderkey + 1000000 AS o_orderkey", "o_custkey", "date_add(o_orderdate, 3) AS o_orderdate")
    both = later.unionByName(orders).repartition(7)
    both.write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(r.o_custkey % 30, r.o_orderdate, r.o_orderkey, False, r.o_orderkey * 7 % 11) for r in both.collect()]
    rows += [(t, d + dt.timedelta(days=3), k + 1_000_000, True, None) for t, d, k, _, _ in rows if k % 10 == 0]
    want, last = [], {}
    for team, _, k, to_come, score in sorted(rows, key=lambda r: r[:4]):
        five = last.setdefault(team, [])
        known = [s for s in five[-5:] if s is not None]
        if to_come:
            want.append((k, team, round(sum(known) / len(known), 6) if known else None))
        five.append(score)
    got = __spark_entry__.queries()["u04_append_scheduled"](spark, str(tmp_path)).collect()
    assert sorted((r.game_id, r.team, r.form) for r in got) == sorted(want)
