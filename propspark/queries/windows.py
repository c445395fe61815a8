"""Trailing windows on the driver's tables. Entity days come from events, one row per entity and day where a window needs it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from propspark.operators import windows as W
from propspark.operators.ordered import trailing_rows
from propspark.queries.registry import query
from propspark.views import table, view, with_views

r6 = lambda c: F.round(c, 6)
DAYS = ", d AS (SELECT entity_id, day, CAST(sum(n) AS BIGINT) AS n, round(sum(v_sum), 6) AS v, CAST(sum(hi) AS BIGINT) AS hi FROM entity_day GROUP BY 1, 2) "
RANGE = "OVER (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"


def days(spark, sf):
    ev = view(spark, sf, "entity_day")
    return W.daily_counts(ev, "entity_id", "day", {"n": F.sum("n"), "v": r6(F.sum("v_sum")), "hi": F.sum("hi")})


def ev(sql):
    return with_views(DAYS + sql, "entity_day")


@query("w01_rolling_days", ev(f"SELECT entity_id, day, CAST(sum(n) {RANGE.format(7)} AS BIGINT) AS n_7d, CAST(sum(hi) {RANGE.format(7)} AS BIGINT) AS hi_7d FROM d"))
def w01(spark, sf):
    return W.rolling_days(days(spark, sf), "entity_id", "day", ["n", "hi"], 7).select("entity_id", "day", "n_7d", "hi_7d")


@query(
    "w02_arsenal",
    with_views(
        """, p AS (SELECT entity_id, day, sum(CASE WHEN kind = 'view' THEN n ELSE 0 END) AS n1, sum(CASE WHEN kind = 'view' THEN v_sum ELSE 0 END) AS v1, sum(CASE WHEN kind = 'click' THEN n ELSE 0 END) AS n2, sum(CASE WHEN kind = 'click' THEN v_sum ELSE 0 END) AS v2, sum(n) AS a FROM entity_day GROUP BY 1, 2),
        s AS (SELECT entity_id, day, sum(n1) OVER w AS n1, sum(v1) OVER w AS v1, sum(n2) OVER w AS n2, sum(v2) OVER w AS v2, sum(a) OVER w AS a FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
        m AS (SELECT *, CASE WHEN n1 >= 2 THEN v1 / n1 END AS m1, CASE WHEN n2 >= 2 THEN v2 / n2 END AS m2, CASE WHEN n1 + n2 >= 2 THEN (v1 + v2) / (n1 + n2) END AS mb FROM s)
        SELECT entity_id, day, round(CAST(n1 AS DOUBLE) / a, 6) AS view_share, round(CAST(n2 AS DOUBLE) / a, 6) AS click_share, round(CAST(n1 + n2 AS DOUBLE) / a, 6) AS seen_share,
               round(coalesce(m1, mb), 6) AS view_mean, round(coalesce(m2, mb), 6) AS click_mean, round(mb, 6) AS seen_mean FROM m""",
        "entity_day",
    ),
)
def w02(spark, sf):
    out = W.arsenal(view(spark, sf, "entity_day"), "entity_id", "day", "kind", ["view", "click"], {"seen": ["view", "click"]}, "n", "v_sum", 10, 2)
    return out.select("entity_id", "day", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query("w03_trend", ev(f"SELECT entity_id, day, round(sum(v) {RANGE.format(5)} / sum(n) {RANGE.format(5)} - sum(v) {RANGE.format(20)} / sum(n) {RANGE.format(20)}, 6) AS trend FROM d"))
def w03(spark, sf):
    return days(spark, sf).select("entity_id", "day", r6(W.trend(None, "entity_id", "day", "v", "n", 5, 20)).alias("trend"))


@query("w04_rolling_weighted", ev(f"SELECT entity_id, day, round(sum(v / n * n) {RANGE.format(14)} / sum(n) {RANGE.format(14)}, 6) AS mean_14d FROM d"))
def w04(spark, sf):
    d = days(spark, sf).withColumn("m", F.col("v") / F.col("n"))
    return d.select("entity_id", "day", r6(W.rolling_weighted("entity_id", "day", "m", "n", 14)).alias("mean_14d"))


@query(
    "w05_rolling_rows",
    ev(
        """SELECT entity_id, day, round(CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END, 6) AS mean5, round(CASE WHEN count(v) OVER w >= 3 THEN stddev_samp(v) OVER w END, 6) AS std5, CASE WHEN count(v) OVER w >= 1 THEN max(v) OVER w END AS max5
        FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
    ),
)
def w05(spark, sf):
    row = lambda how, m: W.rolling_rows("entity_id", ["day"], "v", 5, how, m)
    return days(spark, sf).select("entity_id", "day", r6(row("mean", 3)).alias("mean5"), r6(row("std", 3)).alias("std5"), row("max", 1).alias("max5"))


@query(
    "w06_season_to_date",
    with_views("SELECT game_id, home_team, season, round(avg(home_score) OVER (PARTITION BY home_team, season ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_score FROM team_game", "team_game"),
)
def w06(spark, sf):
    return view(spark, sf, "team_game").select("game_id", "home_team", "season", r6(W.season_to_date("home_team", "season", ["day", "game_id"], "home_score")).alias("mean_score"))


@query("w07_expanding", ev("SELECT entity_id, day, round(CASE WHEN count(v) OVER w >= 4 THEN avg(v) OVER w END, 6) AS mean_before FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def w07(spark, sf):
    return days(spark, sf).select("entity_id", "day", r6(W.expanding("entity_id", ["day"], "v", "mean", 4)).alias("mean_before"))


@query(
    "w08_early_late",
    """WITH s AS (SELECT conv_id, length(text) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
       SELECT conv_id, round(avg(CASE WHEN k <= 2 THEN x END), 6) AS early, round(avg(CASE WHEN k > 2 THEN x END), 6) AS late FROM s GROUP BY conv_id""",
)
def w08(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", F.length("text").alias("x"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("k"))
    return s.groupBy("conv_id").agg(r6(F.avg(F.when(F.col("k") <= 2, F.col("x")))).alias("early"), r6(F.avg(F.when(F.col("k") > 2, F.col("x")))).alias("late"))


@query(
    "w09_rest",
    ev(f"SELECT entity_id, day, CAST(coalesce(least(day - lag(day) OVER (PARTITION BY entity_id ORDER BY day), 10), 10) AS INT) AS rest, CAST(coalesce(least(day - lag(day) OVER (PARTITION BY entity_id ORDER BY day), 10), 10) = 1 AS INT) AS back_to_back, CAST(coalesce(sum(n) {RANGE.format(7)}, 0) AS BIGINT) AS last7 FROM d"),
)
def w09(spark, sf):
    rest = W.rest_days("entity_id", "day", 10, 10)
    return days(spark, sf).select("entity_id", "day", rest.alias("rest"), (rest == 1).cast("int").alias("back_to_back"), W.games_last("entity_id", "day", "n").alias("last7"))


@query(
    "w10_role",
    ev("SELECT entity_id, day, lag(CAST(hi > 0 AS INT)) OVER (PARTITION BY entity_id ORDER BY day) AS started_last, round(avg(CAST(hi > 0 AS INT)) OVER (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS start_rate FROM d"),
)
def w10(spark, sf):
    d = days(spark, sf).withColumn("s", (F.col("hi") > 0).cast("int"))
    return d.select("entity_id", "day", W.lag_flag("entity_id", ["day"], "s").alias("started_last"), r6(W.rolling_rows("entity_id", ["day"], "s", 10)).alias("start_rate"))


@query(
    "w11_head_to_head",
    with_views("SELECT game_id, home_team, away_team, round(sum(home_score - 5.0) OVER w / (count(*) OVER w + 4), 6) AS residual FROM team_game WINDOW w AS (PARTITION BY home_team, away_team ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "team_game"),
)
def w11(spark, sf):
    g = view(spark, sf, "team_game").withColumn("form", F.lit(5.0))
    return g.select("game_id", "home_team", "away_team", r6(W.h2h_residual("home_team", "away_team", ["day", "game_id"], "home_score", "form", 4)).alias("residual"))


PARK = """, g AS (SELECT home_team, day, home_score + away_score AS runs FROM team_game),
        v AS (SELECT home_team, day, count(*) AS g, sum(runs) AS v FROM g GROUP BY 1, 2), l AS (SELECT day, count(*) AS g, sum(runs) AS v FROM g GROUP BY 1),
        o AS (SELECT home_team, day, sum(g) OVER w AS games, sum(v) OVER w AS vs FROM v WINDOW w AS (PARTITION BY home_team ORDER BY day RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
        r AS (SELECT day, sum(v) OVER w / sum(g) OVER w AS rate FROM l WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))
        SELECT home_team, day, CAST(games AS BIGINT) AS games, round(CASE WHEN games >= 30 THEN vs / games / rate END, 6) AS factor FROM o JOIN r USING (day)"""


@query("w12_park_factor", with_views(PARK, "team_game"))
def w12(spark, sf):
    g = view(spark, sf, "team_game").withColumn("runs", F.col("home_score") + F.col("away_score"))
    return W.park_factor_rolling(g, "home_team", "day", "runs").select("home_team", "day", "games", r6("factor").alias("factor"))


@query("w13_luck_gap", ev(f"SELECT entity_id, day, round((sum(hi - 0.3 * n) {RANGE.format(10)}) / sum(n) {RANGE.format(10)}, 6) AS gap_10, round((sum(hi - 0.3 * n) {RANGE.format(20)}) / sum(n) {RANGE.format(20)}, 6) AS gap_20 FROM d"))
def w13(spark, sf):
    d = days(spark, sf).withColumn("x", F.col("hi") - 0.3 * F.col("n"))
    return d.select("entity_id", "day", *[r6(W.rolling_mean(None, "entity_id", "day", "x", "n", n)).alias(f"gap_{n}") for n in (10, 20)])


@query(
    "w14_rate_less_league",
    ev(
        f""", l AS (SELECT day, sum(hi) AS a, sum(n) AS b FROM d GROUP BY 1), r AS (SELECT day, CAST(sum(a) OVER w AS DOUBLE) / sum(b) OVER w AS rate FROM l WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 20 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
        o AS (SELECT entity_id, day, sum(hi) {RANGE.format(20)} AS a, sum(n) {RANGE.format(20)} AS b FROM d)
        SELECT entity_id, o.day, round(CASE WHEN o.b >= 5 THEN CAST(o.a AS DOUBLE) / o.b - rate END, 6) AS rate_gap FROM o JOIN r USING (day)"""
    ),
)
def w14(spark, sf):
    return W.rate_less_league(days(spark, sf), "entity_id", "day", "hi", "n", 20, 5).select("entity_id", "day", r6("rate_gap").alias("rate_gap"))


@query(
    "w15_lineup_beside",
    """WITH o AS (SELECT l_orderkey, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, round(avg(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS ahead,
              round(avg(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 6) AS behind FROM o""",
)
def w15(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_quantity").alias("q"))
    beside = lambda a: r6(W.mean_beside("l_orderkey", "l_linenumber", "q", a))
    return o.select("l_orderkey", "l_linenumber", beside(True).alias("ahead"), beside(False).alias("behind"))


@query("w16_argmax", with_views(", c AS (SELECT entity_id, kind, CAST(sum(n) AS BIGINT) AS n FROM entity_day GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, kind) AS k FROM c) SELECT entity_id, kind, n FROM r WHERE k = 1", "entity_day"))
def w16(spark, sf):
    return W.argmax_by(view(spark, sf, "entity_day"), "entity_id", "kind", "n")


TEAM = ", t AS (SELECT CAST(entity_id % 5 AS INT) AS team, entity_id, day, CAST(sum(n) AS BIGINT) AS n FROM entity_day GROUP BY 1, 2, 3), s AS (SELECT DISTINCT team, day FROM t), m AS (SELECT s.team, s.day, t.entity_id, sum(t.n) AS total FROM s JOIN t ON t.team = s.team AND t.day < s.day AND t.day >= s.day - INTERVAL 10 DAYS GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY team, day ORDER BY total DESC, entity_id) AS place FROM m) "


def team(spark, sf, teams=5):
    return view(spark, sf, "entity_day").groupBy((F.col("entity_id") % teams).cast("int").alias("team"), "entity_id", "day").agg(F.sum("n").alias("n"))


@query("w17_absent_topk", with_views(TEAM + "SELECT k.team, k.day, CAST(count(*) FILTER (t.entity_id IS NULL) AS BIGINT) AS absent FROM k LEFT JOIN t ON t.team = k.team AND t.day = k.day AND t.entity_id = k.entity_id WHERE place <= 5 GROUP BY 1, 2", "entity_day"))
def w17(spark, sf):
    return W.absent_topk(team(spark, sf), "team", "entity_id", "day", "n", 10, 5)


@query(
    "w18_topk_available",
    with_views(TEAM.replace("entity_id % 5", "entity_id % 20") + "SELECT team, day, round(avg(CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.team = k.team AND t.entity_id = k.entity_id AND t.day < k.day AND t.day >= k.day - INTERVAL 1 DAYS) THEN 0.0 ELSE 1.0 END), 6) AS available FROM k WHERE place <= 3 GROUP BY 1, 2", "entity_day"),
)
def w18(spark, sf):
    return W.topk_available(team(spark, sf, 20), "team", "entity_id", "day", "n", 10, 3, 1).select("team", "day", r6("available").alias("available"))


@query(
    "w19_lineup_profile",
    with_views(TEAM + ", j AS (SELECT *, CAST(entity_id * 7 % 30 AS DOUBLE) AS h FROM k WHERE place <= 6), r AS (SELECT *, row_number() OVER (PARTITION BY team, day ORDER BY h DESC, entity_id) AS hr FROM j) SELECT team, day, round(avg(h), 6) AS mean_k, round(avg(h) FILTER (hr <= 3), 6) AS mean_top FROM r GROUP BY 1, 2", "entity_day"),
)
def w19(spark, sf):
    t = team(spark, sf)
    heights = t.select("entity_id").distinct().withColumn("h", (F.col("entity_id") * 7 % 30).cast("double"))
    out = W.lineup_profile(t, "team", "entity_id", "day", "n", heights, "h", 10, 6, 3)
    return out.select("team", "day", r6("mean_k").alias("mean_k"), r6("mean_top").alias("mean_top"))


@query("w20_ffill", ev("SELECT entity_id, day, CAST(coalesce(last_value(CASE WHEN hi > 0 THEN hi END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS filled FROM d"))
def w20(spark, sf):
    d = days(spark, sf).withColumn("x", F.when(F.col("hi") > 0, F.col("hi")))
    return d.select("entity_id", "day", W.ffill("entity_id", ["day"], "x", 0).cast("long").alias("filled"))


@query(
    "w21_streak",
    """WITH i AS (SELECT conv_id, turn, role = 'user' AS f, sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
       SELECT conv_id, turn, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""",
)
def w21(spark, sf):
    c = table(spark, sf, "conversations").withColumn("f", F.col("role") == "user")
    return W.streak(c, "conv_id", ["turn"], "f").select("conv_id", "turn", "streak")


@query("w22_days_to_gap", with_views(", d AS (SELECT DISTINCT entity_id, day FROM entity_day), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY entity_id ORDER BY day) AS INT) AS g FROM d) SELECT entity_id, day, CAST(least(max(day) OVER (PARTITION BY entity_id, g) - day + 1, 7) AS INT) AS days_to_gap FROM i", "entity_day"))
def w22(spark, sf):
    return W.days_to_gap(view(spark, sf, "entity_day"), "entity_id", "day")


@query(
    "w24_drawdown",
    with_views(
        """, b AS (SELECT market_id, book_id, prop_date, sum(CASE WHEN actual > line THEN 0.9 ELSE -1 END) AS p FROM quotes GROUP BY 1, 2, 3),
        c AS (SELECT *, sum(p) OVER w AS c FROM b WINDOW w AS (PARTITION BY market_id, book_id ORDER BY prop_date ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT *, greatest(0, max(c) OVER w) AS peak FROM c WINDOW w AS (PARTITION BY market_id, book_id ORDER BY prop_date ROWS UNBOUNDED PRECEDING))
        SELECT market_id, book_id, round(CAST(sum(p) AS DOUBLE), 6) AS total, round(CAST(min(c - peak) AS DOUBLE), 6) AS drawdown FROM k GROUP BY 1, 2""",
        "quotes",
    ),
)
def w24(spark, sf):
    q = view(spark, sf, "quotes").withColumn("p", F.when(F.col("actual") > F.col("line"), 0.9).otherwise(-1.0))
    daily = q.groupBy("market_id", "book_id", "prop_date").agg(F.sum("p").alias("p"))
    return W.max_drawdown(daily, ["market_id", "book_id"], "prop_date", "p").select("market_id", "book_id", r6("total").alias("total"), r6("drawdown").alias("drawdown"))


@query("w25_latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w25(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return W.latest_per(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("w26_rolling_edge", with_views("SELECT doc_id, grp, round(CASE WHEN count(p) OVER w >= 10 THEN avg(p) OVER w END, 6) AS mean_p FROM scored WINDOW w AS (PARTITION BY grp ORDER BY doc_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)", "scored"))
def w26(spark, sf):
    mean = lambda w: F.when(F.count("p").over(w) >= 10, F.avg("p").over(w))
    out = trailing_rows(view(spark, sf, "scored").select("doc_id", "grp", "p"), ["grp"], ["doc_id"], 40, {"mean_p": mean})
    return out.select("doc_id", "grp", r6("mean_p").alias("mean_p"))


@query(
    "w27_tendencies",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'click' AND hour(ts) < 12) AS early, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT user_id, day, round(avg(c) OVER w, 6) AS clicks_10, round(CAST(sum(early) OVER w AS DOUBLE) / nullif(sum(c) OVER w, 0), 6) AS early_share FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def w27(spark, sf):
    is_click = F.col("event_type") == "click"
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    d = W.daily_counts(e, "user_id", "day", {"c": F.count_if(is_click), "early": F.count_if(is_click & (F.hour("ts") < 12))})
    row = lambda c, how: W.rolling_rows("user_id", ["day"], c, 10, how)
    total = row("c", "sum")
    return d.select("user_id", "day", r6(row("c", "mean")).alias("clicks_10"), r6(F.when(total > 0, row("early", "sum") / total)).alias("early_share"))


@query("w28_open_close", with_views("SELECT prop_id, source, arg_min(over_odds, quote_id) AS opening, arg_max(over_odds, quote_id) AS closing, count(*) AS n FROM snap GROUP BY 1, 2", "snap"))
def w28(spark, sf):
    return W.open_close(view(spark, sf, "snap"), ["prop_id", "source"], "captured_at", "quote_id", "over_odds")


@query(
    "w29_streak_stats",
    with_views(
        """, b AS (SELECT market_id, book_id, prop_date, player_id, line, CASE WHEN actual > line THEN 'win' ELSE 'loss' END AS r, CASE WHEN actual > line THEN 0.9 ELSE -1 END AS p FROM quotes),
        i AS (SELECT *, row_number() OVER o - row_number() OVER (PARTITION BY market_id, book_id, r ORDER BY prop_date, player_id, line) AS g, 100 + sum(p) OVER (PARTITION BY market_id, book_id ORDER BY prop_date, player_id, line ROWS UNBOUNDED PRECEDING) AS bank FROM b WINDOW o AS (PARTITION BY market_id, book_id ORDER BY prop_date, player_id, line)),
        k AS (SELECT *, greatest(100, max(bank) OVER (PARTITION BY market_id, book_id ORDER BY prop_date, player_id, line ROWS UNBOUNDED PRECEDING)) AS peak, count(*) OVER (PARTITION BY market_id, book_id, r, g) AS len FROM i)
        SELECT market_id, book_id, coalesce(max(len) FILTER (r = 'win'), 0) AS longest_win, coalesce(max(len) FILTER (r = 'loss'), 0) AS longest_loss, round(CAST(min(bank / CAST(peak AS DOUBLE) - 1) AS DOUBLE), 6) AS worst_fall FROM k GROUP BY 1, 2""",
        "quotes",
    ),
)
def w29(spark, sf):
    q = view(spark, sf, "quotes").withColumn("r", F.when(F.col("actual") > F.col("line"), "win").otherwise("loss")).withColumn("p", F.when(F.col("r") == "win", 0.9).otherwise(-1.0))
    out = W.streak_stats(q, ["market_id", "book_id"], ["prop_date", "player_id", "line"], "r", "p", 100.0)
    return out.select("market_id", "book_id", "longest_win", "longest_loss", r6("worst_fall").alias("worst_fall"))


@query(
    "w23_travel",
    with_views(
        """, z AS (SELECT *, away_team % 4 - home_team % 4 AS lag_hours, CAST((game_id * 3) % 24 AS INT) AS utc_hour FROM team_game)
        SELECT game_id, CAST(lag_hours AS INT) AS lag_hours, CAST((utc_hour - 5 + home_team % 4 + 24) % 24 AS INT) AS local_hour, (utc_hour - 5 + home_team % 4 + 24) % 24 >= 17 AS is_night, lag_hours < 0 AS eastward FROM z""",
        "team_game",
    ),
)
def w23(spark, sf):
    from propspark.operators.joins import travel

    g = view(spark, sf, "team_game").withColumn("utc_hour", (F.col("game_id") * 3 % 24).cast("int"))
    zones = spark.range(30).selectExpr("CAST(id AS INT) AS team", "CAST(id % 4 - 5 AS INT) AS tz")
    return travel(g, zones).select("game_id", "lag_hours", "local_hour", "is_night", "eastward")
