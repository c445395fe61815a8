"""Sources and sinks on the driver's tables. Tables that a query writes lie in a folder of its own beside the session's warehouse or checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from propspark.queries.registry import query
from propspark.sources import io as IO
from propspark.views import table, view, with_views


def work_dir(spark, label):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("s01_read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1995-07-01'")
def s01(spark, sf):
    return IO.read_table(spark, sf, "orders", "1995-01-01", "1995-07-01", "o_orderdate", ["o_orderkey", "o_totalprice"])


@query("s02_cached", with_views("SELECT game_id, home_score, season FROM team_game", "team_game"))
def s02(spark, sf):
    path = work_dir(spark, "cache")
    build = lambda: view(spark, sf, "team_game").select("game_id", "home_score", "season")
    IO.cached(spark, path, build, "season")
    return IO.cached(spark, path, lambda: build().limit(0), "season").select("game_id", "home_score", "season")


@query("s03_csv", with_views("SELECT game_id, day, home_score FROM team_game", "team_game"))
def s03(spark, sf):
    path = work_dir(spark, "csv")
    IO.write_csv(view(spark, sf, "team_game").select("game_id", "day", "home_score", "season"), path)
    return IO.read_csv(spark, path, "game_id LONG, day DATE, home_score INT, season INT", ["game_id", "day", "home_score"])


@query("s04_flatten_json", "SELECT event_id, event_id AS prop_id, 'p' || user_id AS player_first, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS over_line, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS over_odds, CASE WHEN event_id % 4 <> 0 THEN value / 2 END AS actual FROM events")
def s04(spark, sf):
    odds = F.get_json_object("props", "$.k").cast("int")
    over = F.when(F.col("event_id") % 3 != 0, F.struct(F.col("value").alias("line"), odds.alias("odds")))
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.concat(F.lit("p"), "user_id").alias("first")).alias("player"), over.alias("over"), F.when(F.col("event_id") % 4 != 0, F.struct((F.col("value") / 2).alias("actual"))).alias("score"))).alias("j"))
    return IO.flatten_prop(e, "j").select("event_id", "prop_id", "player_first", "over_line", "over_odds", "actual")


@query("s05_flatten_lines", "SELECT o_orderkey AS payload_id, 'L' || l_linenumber AS line_id, 'player ' || l_partkey AS player, 'hits' AS stat, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE c END AS choice, l_quantity AS value FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey JOIN (VALUES ('higher'), ('lower')) v(c) ON l_linenumber % 3 <> 0 OR c = 'higher'")
def s05(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").alias("q"))
    li = li.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    n = F.col("l_linenumber").cast("string")
    option = lambda c: F.struct(F.lit(c).alias("choice"), F.lit(-110).alias("price"))
    parts = F.struct(
        F.struct(F.concat(F.lit("P"), n).alias("id"), F.concat(F.lit("player "), F.col("part").cast("string")).alias("name")).alias("p"),
        F.struct(F.concat(F.lit("A"), n).alias("id"), F.concat(F.lit("P"), n).alias("player_id")).alias("a"),
        F.struct(F.concat(F.lit("L"), n).alias("id"), F.concat(F.lit("A"), n).alias("appearance_id"), F.lit("hits").alias("stat"), F.col("q").cast("double").alias("value"), F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<struct<choice:string,price:int>>")).otherwise(F.array(option("higher"), option("lower"))).alias("options")).alias("l"),
    )
    held = li.groupBy(F.col("l_orderkey").alias("payload_id")).agg(F.collect_list(parts).alias("x"))  # the lines of one order
    payload = held.select("payload_id", F.to_json(F.struct(F.col("x.p").alias("players"), F.col("x.a").alias("appearances"), F.col("x.l").alias("lines"))).alias("j"))
    return IO.flatten_lines(payload, "payload_id", "j").select("payload_id", "line_id", "player", "stat", "choice", "value")


@query("s06_pick_side", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS under_price FROM events")
def s06(spark, sf):
    side = lambda n, v: F.struct(F.lit(n).alias("side"), v.alias("price"))
    over, under = side("over", -F.col("value")), side("under", F.col("value"))
    options = F.when(F.col("event_id") % 4 == 0, F.array(over)).otherwise(F.array(over, under))
    return table(spark, sf, "events").select("event_id", IO.pick_side(options, "side", "under")["price"].alias("under_price"))


@query(
    "s07_odds_map",
    with_views(
        """, g AS (SELECT DISTINCT day, home_team, away_team, max(home_score) AS hs, max(away_score) AS aws FROM team_game GROUP BY 1, 2, 3)
        SELECT day, 'T' || home_team AS home, 'T' || away_team AS away, m AS market, CASE m WHEN 'spread' THEN hs - 5.5 WHEN 'total' THEN hs + 3.5 END AS line, CAST(CASE m WHEN 'moneyline' THEN -110 - hs WHEN 'spread' THEN -105 ELSE -115 END AS INT) AS first_odds, CAST(CASE m WHEN 'moneyline' THEN 100 + aws WHEN 'spread' THEN -105 ELSE -105 END AS INT) AS second_odds
        FROM g JOIN (VALUES ('moneyline'), ('spread'), ('total')) v(m) ON m <> 'spread' OR hs % 2 = 0""",
        "team_game",
    ),
)
def s07(spark, sf):
    g = view(spark, sf, "team_game").groupBy("day", "home_team", "away_team").agg(F.max("home_score").alias("hs"), F.max("away_score").alias("aws"))
    pair = lambda names, *c: F.struct(*[x.alias(n) for n, x in zip(names, c, strict=True)])
    spread = F.when(F.col("hs") % 2 == 0, pair(["line", "home", "away"], F.col("hs") - 5.5, F.lit(-105), F.lit(-105)))
    game = F.struct(F.concat(F.lit("T"), F.col("home_team").cast("string")).alias("home"), F.concat(F.lit("T"), F.col("away_team").cast("string")).alias("away"), pair(["home", "away"], -110 - F.col("hs"), 100 + F.col("aws")).alias("moneyline"), spread.alias("spread"), pair(["line", "over", "under"], F.col("hs") + 3.5, F.lit(-115), F.lit(-105)).alias("total"))
    daily = g.groupBy("day").agg(F.collect_list(game).alias("games"))  # the games of one day
    return IO.load_odds_map(daily.select(F.to_json(F.create_map(F.col("day").cast("string"), F.col("games"))).alias("j")), "j")


@query("s08_embedded_json", "SELECT page_id, TRY_CAST(nullif(regexp_extract(html, 'track\\((\\d+)\\)', 1), '') AS INT) AS track_no, nullif(regexp_extract(html, '<html lang=\"(\\w+)\"', 1), '') AS lang FROM pages")
def s08(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", F.regexp_replace("html", r"track\((\d+)\)", r'state={"no":$1};'))
    lang = F.nullif(F.regexp_extract("html", r'<html lang="(\w+)"', 1), F.lit(""))
    return IO.extract_embedded_json(pages, "html", r"state=(\{[^}]*\})", "no INT").select("page_id", F.col("blob.no").alias("track_no"), lang.alias("lang"))


@query("s09_append_new", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def s09(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return IO.append_new(o.where("o_orderkey % 3 = 0"), o, ["o_custkey"], ["o_orderkey"])


@query(
    "s10_upsert",
    with_views(
        """, t AS (SELECT player_id, line, over_odds AS price, CAST(NULL AS INT) AS closing_price, CAST(NULL AS DOUBLE) AS actual FROM quotes WHERE book_id = 1 AND player_id % 4 <> 0), b AS (SELECT player_id, line, under_odds AS price, CASE WHEN player_id % 3 = 0 THEN NULL ELSE actual END AS actual FROM quotes WHERE book_id = 1 AND player_id % 5 <> 0)
        SELECT coalesce(t.player_id, b.player_id) AS player_id, coalesce(t.line, b.line) AS line, CASE WHEN t.player_id IS NULL THEN b.price ELSE t.price END AS price, coalesce(b.price, t.closing_price) AS closing_price, coalesce(b.actual, t.actual) AS actual FROM t FULL JOIN b ON t.player_id = b.player_id AND t.line = b.line""",
        "quotes",
    ),
)
def s10(spark, sf):
    q = view(spark, sf, "quotes").where("book_id = 1")
    t = q.where("player_id % 4 <> 0").selectExpr("player_id", "line", "over_odds AS price", "CAST(NULL AS INT) AS closing_price", "CAST(NULL AS DOUBLE) AS actual")
    b = q.where("player_id % 5 <> 0").select("player_id", "line", F.col("under_odds").alias("price"), F.when(F.col("player_id") % 3 != 0, F.col("actual")).alias("actual"))
    return IO.upsert(t, b, ["player_id", "line"], ["actual"], {"price": "closing_price"})


@query("s11_new_only", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')")
def s11(spark, sf):
    return IO.new_only(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderdate >= DATE '2001-01-01'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("s12_changed_rows", with_views("SELECT game_id, CASE WHEN game_id % 4 = 0 THEN NULL ELSE home_score + CAST(game_id % 4 = 1 AS INT) END AS home_score FROM team_game WHERE game_id % 4 IN (0, 1)", "team_game"))
def s12(spark, sf):
    old = view(spark, sf, "team_game").select("game_id", "home_score")
    new = old.withColumn("home_score", F.when(F.col("game_id") % 4 != 0, F.col("home_score") + (F.col("game_id") % 4 == 1).cast("int")))
    return IO.changed_rows(new, old, "game_id", ["home_score"])


@query("s13_health", "SELECT 'orders' AS table_name, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS latest FROM orders UNION ALL SELECT 'events', count(*), max(CAST(ts AS DATE)) FROM events")
def s13(spark, sf):
    return IO.health({"orders": (table(spark, sf, "orders"), "o_orderdate"), "events": (table(spark, sf, "events"), "ts")})


@query("s13_coverage", with_views("SELECT kind, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM entity_day GROUP BY 1", "entity_day"))
def s13b(spark, sf):
    return IO.coverage_by(view(spark, sf, "entity_day"), ["kind"], "day")


@query("s14_column_profile", with_views("SELECT 'v_sum' AS column_name, 1.0 AS filled, round(avg(v_sum), 6) AS mean, round(quantile_cont(v_sum, 0.1), 6) AS p10, round(quantile_cont(v_sum, 0.9), 6) AS p90 FROM entity_day UNION ALL SELECT 'rate', round(count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE), 6), round(avg(CASE WHEN n > 1 THEN hi END), 6), round(quantile_cont(CAST(hi AS DOUBLE), 0.1) FILTER (n > 1), 6), round(quantile_cont(CAST(hi AS DOUBLE), 0.9) FILTER (n > 1), 6) FROM entity_day", "entity_day"))
def s14(spark, sf):
    e = view(spark, sf, "entity_day").withColumn("rate", F.when(F.col("n") > 1, F.col("hi").cast("double")))
    out = IO.column_profile(e, ["v_sum", "rate"])
    return out.select("column_name", *[F.round(c, 6).alias(c) for c in ("filled", "mean", "p10", "p90")])
