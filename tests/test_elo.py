import __spark_entry__
from propspark.views import league_games

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def test_every_game_is_rated(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    rated = QUERIES["m10_elo"](spark, SF)
    assert rated.select("game_id").distinct().count() == rated.count() == orders.count()
    moved = rated.where("home_elo <> 1500 OR away_elo <> 1500").count()
    assert moved > 0.8 * orders.count()


def test_both_teams_are_of_the_league(spark):
    g = league_games(spark, SF)
    assert g.where("home_team = away_team OR floor(home_team / 30) <> league OR floor(away_team / 30) <> league").count() == 0
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert g.select("league").distinct().count() >= customers // 30


def test_matrix_rates_league_by_league(spark):
    got = QUERIES["c11_game_matrix"](spark, SF).where("game_id < 10000000")
    assert got.select("league").distinct().count() == league_games(spark, SF).select("league").distinct().count() > 1
    apart = QUERIES["m10_elo"](spark, SF).withColumnsRenamed({"home_elo": "h", "away_elo": "a"})
    assert got.join(apart, "game_id").where("abs(home_elo - h) > 1e-9 OR abs(away_elo - a) > 1e-9").count() == 0
