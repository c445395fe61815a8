"""Stand-in views that give the driver's tables the shape of quotes, entity days and games.

The same SQL text runs in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTES = """
SELECT DATE '2024-04-01' + CAST(player_id % 180 AS INT) AS prop_date,
       CAST(player_id % 5 AS INT) AS market_id, book_id, player_id,
       CAST(line0 AS DOUBLE) AS line,
       CASE WHEN flip = 0 THEN -(110 + d)
            WHEN d <= 9 THEN -(110 - d) ELSE 100 + (d - 9) END AS over_odds,
       CASE WHEN flip = 1 THEN -(110 + d)
            WHEN d <= 9 THEN -(110 - d) ELSE 100 + (d - 9) END AS under_odds,
       CAST((player_id * 13) % 7 AS DOUBLE) AS actual
FROM (
  SELECT CAST(l_partkey AS BIGINT) AS player_id,
         CAST(l_suppkey % 4 AS INT) AS book_id,
         CAST(l_quantity AS INT) % 5 + 0.5 AS line0,
         CAST(round(l_discount * 100) AS INT) * 3 AS d,
         CAST(l_linenumber % 2 AS INT) AS flip,
         row_number() OVER (PARTITION BY l_partkey, l_suppkey % 4, CAST(l_quantity AS INT) % 5
                            ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount) AS rn
  FROM {lineitem}) b
WHERE rn = 1
"""
ENTITY_DAY = """
SELECT user_id AS entity_id, CAST(ts AS DATE) AS day, event_type AS kind,
       COUNT(*) AS n, round(SUM(value), 6) AS v_sum,
       CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS hi
FROM {events} GROUP BY user_id, CAST(ts AS DATE), event_type
"""
TEAM_GAME = """
SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS day,
       CAST(year(o_orderdate) AS INT) AS season,
       CAST(o_custkey % 30 AS INT) AS home_team,
       CAST((o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS INT) AS away_team,
       CAST(o_orderkey * 7 % 11 AS INT) AS home_score, CAST(o_orderkey * 5 % 9 AS INT) AS away_score
FROM {orders}
"""
SCORED = """
SELECT l.doc_id, l.quality AS y, d.source AS grp,
       CAST((d.n_chars % 997) AS DOUBLE) / 997 AS p
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""
SNAP = """
SELECT event_id AS quote_id, CAST(ts AS TIMESTAMP) AS captured_at,
       CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 18 HOURS AS scheduled_start,
       user_id % 20 AS prop_id, event_type AS source,
       CAST(-(105 + CAST(floor(value) AS INT) % 20) AS INT) AS over_odds,
       CAST(-(105 + CAST(floor(value * 10) AS INT) % 20) AS INT) AS under_odds
FROM {events}
"""
PLAYED = f"""
SELECT game_id, day, season, home_team, away_team, home_score, away_score,
       CAST(home_team % 10 AS INT) AS venue, CAST(game_id % 40 AS INT) AS umpire,
       CASE game_id % 6 WHEN 0 THEN 'out to left' WHEN 1 THEN 'dome' WHEN 2 THEN 'in from right' WHEN 3 THEN 'calm.' WHEN 4 THEN 'sunny.' ELSE 'light rain.' END AS weather,
       CAST(CASE WHEN game_id % 11 <> 0 THEN 40 + game_id % 55 END AS INT) AS temperature,
       CAST(CASE WHEN game_id % 13 <> 0 THEN game_id % 19 END AS INT) AS wind,
       CAST((home_score + away_score) % 5 AS INT) AS hr
FROM ({TEAM_GAME}) t WHERE home_team <> away_team
"""
STARTS = f"""
SELECT game_id, home_team * 10 + game_id % 5 AS pitcher_id, home_team AS team, away_team AS opponent, day, season,
       home_score % 7 + CAST(away_score % 3 AS DOUBLE) / 10 AS ip, home_score * 9 + 20 AS pitches
FROM ({PLAYED}) h
UNION ALL
SELECT game_id, away_team * 10 + game_id % 5, away_team, home_team, day, season,
       away_score % 7 + CAST(home_score % 3 AS DOUBLE) / 10, away_score * 9 + 20
FROM ({PLAYED}) a
"""
PLAYER_GAME = f"""
SELECT l.game_id, g.day, g.season, l.ln,
       CASE WHEN l.ln % 2 = 1 THEN g.home_team ELSE g.away_team END AS team,
       CASE WHEN l.ln % 2 = 1 THEN g.away_team ELSE g.home_team END AS opponent,
       CAST(CASE WHEN l.ln % 2 = 1 THEN g.home_team ELSE g.away_team END * 12 + l.ln AS INT) AS player_id,
       CAST(l.q % 36 + 4 AS INT) AS minutes, l.q % 7 < 4 AS is_starter,
       CAST(l.p % 9 AS INT) AS fgm, CAST(l.p % 9 + l.q % 8 AS INT) AS fga, CAST(l.p % 3 AS INT) AS fg3m,
       CAST(l.q % 6 AS INT) AS fta, CAST(l.q % 3 AS INT) AS orb, CAST(l.p % 6 AS INT) AS drb, CAST((l.p + l.q) % 7 AS INT) AS assists,
       CAST(l.p % 4 AS INT) AS turnovers, CAST(2 * (l.p % 9) + l.p % 3 AS INT) AS points
FROM (SELECT l_orderkey AS game_id, CAST(l_linenumber AS INT) AS ln, MIN(l_partkey) AS p, CAST(MIN(l_quantity) AS INT) AS q
      FROM {{lineitem}} GROUP BY l_orderkey, CAST(l_linenumber AS INT)) l
JOIN ({PLAYED}) g ON g.game_id = l.game_id
"""
VIEWS = {"played": PLAYED, "starts": STARTS, "player_game": PLAYER_GAME, "quotes": QUOTES, "entity_day": ENTITY_DAY, "team_game": TEAM_GAME, "scored": SCORED, "snap": SNAP}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(sql: str, *names: str) -> str:
    """`sql` behind the named views as common table expressions over plain table names."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return f"WITH {', '.join(parts)}{sql}" if sql.startswith(",") else f"WITH {', '.join(parts)} {sql}"


def league_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a game of a league: 30 customers make one, and both teams are among them.

    The number of leagues grows with the customers, and a league has its customers' orders.
    """
    o, place = table(spark, sf_dir, "orders"), F.col("o_custkey") % 30
    first = F.col("o_custkey") - place
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").cast("int").alias("season"),
        (first / 30).cast("long").alias("league"),
        F.col("o_custkey").cast("long").alias("home_team"),
        (first + (place + 1 + F.col("o_orderkey") % 29) % 30).cast("long").alias("away_team"),
        (F.col("o_orderkey") * 7 % 11).cast("int").alias("home_score"),
        (F.col("o_orderkey") * 5 % 9).cast("int").alias("away_score"),
    )
