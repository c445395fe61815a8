import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from propspark.queries import jobs

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def test_jobs_take_every_season(spark):
    orders, lines = spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/lineitem.parquet")
    made = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber").distinct()
    assert jobs.player_games(spark, SF).count() == made.count()
    assert QUERIES["c09_basketball_set"](spark, SF).select("game_id").distinct().count() == made.select("l_orderkey").distinct().count()
    first = orders.agg(F.min(F.to_date("o_orderdate"))).first()[0]
    assert QUERIES["c10_shot_profile"](spark, SF).agg(F.min("day")).first()[0].year == first.year
    assert QUERIES["c11_game_matrix"](spark, SF).where("game_id < 10000000").count() == orders.count()


def test_halves_round_as_in_sql(spark):
    """Means whose exact value is a half of the sixth place, one bit off, and others; nulls stay."""
    values = [0.6791874999999999, 0.024687499999999998, -0.6791874999999999, 0.1234564999, 0.0, None]
    values += [(k + 0.5) / 1e6 * (1 + d * 2.2e-16) for k in range(1, 400_000, 997) for d in (-1, 0, 1)]
    got = [r.x for r in jobs.rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")).orderBy("i").collect()]
    db = duckdb.connect()
    assert got == [db.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert got[0] == 0.679188 and got[2] == -0.679188 and got[5] is None
