"""Aggregations, reports and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.functions import odds as O
from propspark.operators import reports as R
from propspark.operators import sets as S
from propspark.operators import windows as W
from propspark.queries.registry import query
from propspark.views import table, view, with_views

r6 = lambda c: F.round(c, 6)


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


#: Bets of the soft book at the sharp book's fair price.
BETS_SQL = """, s AS (SELECT a.prop_date, a.market_id, a.player_id, a.line, a.actual, a.over_odds, a.under_odds,
            CASE WHEN b.over_odds > 0 THEN 100.0 / (b.over_odds + 100) ELSE abs(b.over_odds) / (abs(b.over_odds) + 100.0) END AS po, CASE WHEN b.under_odds > 0 THEN 100.0 / (b.under_odds + 100) ELSE abs(b.under_odds) / (abs(b.under_odds) + 100.0) END AS pu
        FROM quotes a JOIN quotes b ON a.prop_date = b.prop_date AND a.market_id = b.market_id AND a.line = b.line AND a.player_id = b.player_id WHERE a.book_id = 1 AND b.book_id = 2),
        f AS (SELECT *, po / (po + pu) AS fair, CASE WHEN over_odds > 0 THEN over_odds / 100.0 + 1 ELSE 100.0 / abs(over_odds) + 1 END AS dov, CASE WHEN under_odds > 0 THEN under_odds / 100.0 + 1 ELSE 100.0 / abs(under_odds) + 1 END AS dun FROM s),
        bets AS (SELECT *, CASE WHEN fair * dov - 1 >= (1 - fair) * dun - 1 THEN 'over' ELSE 'under' END AS side, greatest(fair * dov - 1, (1 - fair) * dun - 1) AS ev, CASE WHEN fair * dov - 1 >= (1 - fair) * dun - 1 THEN dov ELSE dun END AS payout FROM f),
        settled AS (SELECT *, CASE WHEN (side = 'over') = (actual > line) THEN 'win' ELSE 'loss' END AS result, CASE WHEN (side = 'over') = (actual > line) THEN payout - 1 ELSE -1.0 END AS profit FROM bets) """


def bets(spark, sf):
    from propspark.operators.joins import overlap

    keys = ["prop_date", "market_id", "line", "player_id"]
    both = overlap(view(spark, sf, "quotes"), 1, 2, keys, "book_id", ["over_odds", "under_odds", "actual"])
    fair = O.devig("sharp_over_odds", "sharp_under_odds")
    return R.price_bets(both.withColumn("fair", fair), F.col("fair"), "soft_over_odds", "soft_under_odds", "soft_actual", "line").withColumnRenamed("soft_over_odds", "over_odds")


def q(sql):
    return with_views(BETS_SQL + sql, "quotes")


def flagship(spark, sf):
    out = R.threshold_sweep(bets(spark, sf), [-0.05, 0.0, 0.01, 0.02, 0.03, 0.05])
    return rounded(out, "hit", "roi", "total", "over_share", "per_day")


@query("a01_daily_counts", with_views("SELECT entity_id, day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN kind = 'view' THEN n ELSE 0 END) AS BIGINT) AS views, count(*) FILTER (hi > 0) AS hot_kinds FROM entity_day GROUP BY 1, 2", "entity_day"))
def a01(spark, sf):
    made = {"n": F.sum("n"), "views": F.sum(F.when(F.col("kind") == "view", F.col("n")).otherwise(0)), "hot_kinds": F.count_if(F.col("hi") > 0)}
    return W.daily_counts(view(spark, sf, "entity_day"), "entity_id", "day", made)


@query("a02_pair_counts", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type ILIKE 'CL%') AS clicks, count(*) FILTER (event_type ILIKE '%view%') AS views FROM events GROUP BY 1")
def a02(spark, sf):
    return R.pair_counts(table(spark, sf, "events"), ["user_id"], "event_type", {"clicks": "CL%", "views": "%view%"})


@query("a03_distinct", "SELECT user_id, count(DISTINCT (event_type, CAST(ts AS DATE))) AS n_distinct FROM events GROUP BY 1")
def a03(spark, sf):
    return R.distinct_per(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id"], ["event_type", "day"])


@query(
    "a03_trailing_distinct",
    """WITH e AS (SELECT DISTINCT user_id % 20 AS grp, CAST(ts AS DATE) AS day, user_id FROM events), d AS (SELECT DISTINCT grp, day FROM e)
       SELECT grp, day, (SELECT count(DISTINCT user_id) FROM e WHERE e.grp = d.grp AND e.day < d.day AND e.day >= d.day - INTERVAL 3 DAYS) AS n_distinct FROM d""",
)
def a03_trailing(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("grp"), F.to_date("ts").alias("day"), "user_id")
    return W.trailing_distinct(e, "grp", "day", "user_id", 3)


@query("a04_rate_vs_league", with_views("SELECT entity_id, CAST(sum(n) AS BIGINT) AS n, round(sum(hi) / CAST(sum(n) AS DOUBLE) - (SELECT sum(hi) / CAST(sum(n) AS DOUBLE) FROM entity_day), 6) AS rate_gap FROM entity_day GROUP BY 1 HAVING sum(n) >= 20", "entity_day"))
def a04(spark, sf):
    return rounded(R.rate_vs_league(view(spark, sf, "entity_day"), "entity_id", "hi", "n", 20), "rate_gap")


@query("a04_line_dispersion", with_views("SELECT prop_date, player_id, count(DISTINCT book_id) AS books, max(line) - min(line) AS spread, round(stddev_pop(line), 6) AS sd FROM quotes GROUP BY 1, 2", "quotes"))
def a04b(spark, sf):
    return rounded(R.line_dispersion(view(spark, sf, "quotes"), ["prop_date", "player_id"], "line", "book_id"), "sd")


@query("a05_consensus_line", with_views(", c AS (SELECT player_id, line, count(*) AS n FROM quotes GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, line) AS k FROM c) SELECT player_id, line, n FROM k WHERE k = 1", "quotes"))
def a05(spark, sf):
    return R.consensus_line(view(spark, sf, "quotes"), ["player_id"], "line")


@query("a06_price_summary", with_views("SELECT player_id, line, max(over_odds) AS best, CAST(median(over_odds) AS DOUBLE) AS median, min(over_odds) AS worst, count(DISTINCT book_id) AS books, arg_min(book_id, (-over_odds, book_id)) AS best_book FROM quotes GROUP BY 1, 2", "quotes"))
def a06(spark, sf):
    return R.price_summary(view(spark, sf, "quotes"), ["player_id", "line"], "over_odds", "book_id")


@query("a07_by_priority", with_views(", k AS (SELECT *, row_number() OVER (PARTITION BY player_id, line ORDER BY CASE book_id WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS k FROM quotes WHERE book_id IN (3, 1, 0)) SELECT player_id, line, book_id, over_odds FROM k WHERE k = 1", "quotes"))
def a07(spark, sf):
    return R.by_priority(view(spark, sf, "quotes"), ["player_id", "line"], "book_id", [3, 1, 0], ["over_odds"])


@query("a08_pivot_sides", with_views("SELECT entity_id, day, max(CASE WHEN kind = 'view' THEN n END) AS view, max(CASE WHEN kind = 'click' THEN n END) AS click FROM entity_day GROUP BY 1, 2 HAVING max(CASE WHEN kind = 'view' THEN n END) IS NOT NULL AND max(CASE WHEN kind = 'click' THEN n END) IS NOT NULL", "entity_day"))
def a08(spark, sf):
    return R.pivot_sides(view(spark, sf, "entity_day"), ["entity_id", "day"], "kind", "n", ["view", "click"])


@query("a09_bucket_report", q("SELECT CAST(CASE WHEN ev > -0.1 AND ev <= 0 THEN 1 WHEN ev > 0 AND ev <= 0.02 THEN 2 WHEN ev > 0.02 AND ev <= 0.05 THEN 3 WHEN ev > 0.05 AND ev <= 1 THEN 4 END AS INT) AS bucket, count(*) AS n, round(avg(CAST(result = 'win' AS INT)), 6) AS hit, round(avg(profit), 6) AS roi FROM settled WHERE ev > -0.1 AND ev <= 1 GROUP BY 1"))
def a09(spark, sf):
    return rounded(R.bucket_report(bets(spark, sf), "ev", [-0.1, 0, 0.02, 0.05, 1], "result", "profit"), "hit", "roi")


@query("a10_segments", with_views(", c AS (SELECT quantile_cont(v_sum, 0.25) AS a, quantile_cont(v_sum, 0.5) AS m, quantile_cont(v_sum, 0.75) AS b, min(v_sum) AS z, max(v_sum) AS t FROM entity_day), s AS (SELECT 'low' AS segment, n FROM entity_day, c WHERE v_sum BETWEEN z AND m UNION ALL SELECT 'middle', n FROM entity_day, c WHERE v_sum BETWEEN a AND b UNION ALL SELECT 'high', n FROM entity_day, c WHERE v_sum BETWEEN m AND t) SELECT segment, count(*) AS n, round(avg(n), 6) AS mean FROM s GROUP BY 1", "entity_day"))
def a10(spark, sf):
    return rounded(R.segments(view(spark, sf, "entity_day").withColumnRenamed("n", "x"), "v_sum", {"low": (0.0, 0.5), "middle": (0.25, 0.75), "high": (0.5, 1.0)}, "x"), "mean")


@query("a11_market_gap", q("SELECT market_id, count(*) AS n, round(avg(CAST(actual > line AS INT)) - avg(fair), 6) AS gap, round(sqrt(avg(fair) * (1 - avg(fair)) / count(*)), 6) AS se, round((avg(CAST(actual > line AS INT)) - avg(fair)) / sqrt(avg(fair) * (1 - avg(fair)) / count(*)), 6) AS z FROM settled GROUP BY 1"))
def a11(spark, sf):
    b = bets(spark, sf).withColumn("hit", (F.col("soft_actual") > F.col("line")).cast("int"))
    return rounded(R.market_gap(b, ["market_id"], "hit", "fair"), "gap", "se", "z")


SWEEP = "SELECT {by} CAST(t AS DOUBLE) AS threshold, count(*) AS n, round(avg(CAST(result = 'win' AS INT)), 6) AS hit, round(avg(profit), 6) AS roi, round(sum(profit), 6) AS total, round(avg(CAST(side = 'over' AS INT)), 6) AS over_share, round(count(*) / CAST(count(DISTINCT prop_date) AS DOUBLE), 6) AS per_day FROM settled JOIN (VALUES (-0.05), (0.0), (0.01), (0.02), (0.03), (0.05)) v(t) ON ev >= t GROUP BY {group} t"


@query("a12_threshold_sweep", q(SWEEP.format(by="", group="")))
def a12(spark, sf):
    return flagship(spark, sf)


@query("a13_market_report", q("SELECT market_id, CAST(grouping(market_id) AS INT) AS is_total, count(*) AS n, round(avg(CAST(result = 'win' AS INT)), 6) AS hit, round(avg(profit), 6) AS roi FROM settled GROUP BY ROLLUP (market_id)"))
def a13(spark, sf):
    return rounded(R.market_report(bets(spark, sf), "market_id"), "hit", "roi")


@query("a14_daily_sharpe", q(", d AS (SELECT market_id, prop_date, sum(profit) AS p FROM settled GROUP BY 1, 2) SELECT market_id, count(*) AS days, round(sum(p), 6) AS total, round(avg(p) / nullif(stddev_samp(p), 0), 6) AS sharpe FROM d GROUP BY 1"))
def a14(spark, sf):
    return rounded(R.daily_sharpe(bets(spark, sf), "prop_date", ["market_id"]), "total", "sharpe")


@query("a15_roi_se", q("SELECT market_id, side, count(*) AS n, round(avg(profit), 6) AS roi, round(2 * stddev_samp(profit) / sqrt(count(*)), 6) AS two_se FROM settled GROUP BY 1, 2 HAVING count(*) >= 5"))
def a15(spark, sf):
    return rounded(R.roi_se(bets(spark, sf), ["market_id", "side"], 5), "roi", "two_se")


@query("a16_calibration", with_views("SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual, round(avg(y) - avg(p), 6) AS diff FROM scored GROUP BY 1", "scored"))
def a16(spark, sf):
    return rounded(R.calibration(view(spark, sf, "scored"), "p", "y", 10), "predicted", "actual", "diff")


@query(
    "a17_binary_metrics",
    with_views(
        """, pairs AS (SELECT a.grp, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM scored a JOIN scored b ON a.grp = b.grp AND a.y = 1 AND b.y = 0 GROUP BY 1)
        SELECT s.grp, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) AS log_loss, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)), 6) AS accuracy,
               round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(CASE WHEN stddev_pop(y) > 0 THEN corr(p, y) END, 6) AS corr, round(any_value(auc), 6) AS auc FROM scored s LEFT JOIN pairs USING (grp) GROUP BY 1""",
        "scored",
    ),
)
def a17(spark, sf):
    out = R.binary_metrics(view(spark, sf, "scored"), "p", "y", ["grp"])
    return rounded(out, "brier", "log_loss", "accuracy", "mae", "rmse", "corr", "auc")


@query(
    "a18_vig_audit",
    with_views(
        """, d AS (SELECT *, CASE WHEN over_odds > 0 THEN over_odds / 100.0 + 1 ELSE 100.0 / abs(over_odds) + 1 END AS dov, CASE WHEN under_odds > 0 THEN under_odds / 100.0 + 1 ELSE 100.0 / abs(under_odds) + 1 END AS dun FROM quotes)
        SELECT book_id, market_id, count(*) AS n, round(avg(1 / dov + 1 / dun - 1), 6) AS vig, round(avg(CASE WHEN actual > line THEN dov - 1 ELSE -1.0 END), 6) AS over_roi, round(avg(CASE WHEN actual < line THEN dun - 1 ELSE -1.0 END), 6) AS under_roi FROM d GROUP BY 1, 2""",
        "quotes",
    ),
)
def a18(spark, sf):
    return rounded(R.vig_audit(view(spark, sf, "quotes"), ["book_id", "market_id"], "over_odds", "under_odds", "actual", "line"), "vig", "over_roi", "under_roi")


@query(
    "a19_clv",
    q("""SELECT market_id, count(*) AS n, round(avg(0.5 - fair), 6) AS mean_model_clv, round(avg(CAST(0.5 - fair > 0 AS INT)), 6) AS positive_model_clv, round(avg(fair - 1 / dov), 6) AS mean_execution_clv, round(avg(CAST(fair - 1 / dov > 1e-12 AS INT)), 6) AS positive_execution_clv,
        round(avg(0.5 - 1 / dov), 6) AS mean_total_clv, round(avg(CAST(0.5 - 1 / dov > 1e-12 AS INT)), 6) AS positive_total_clv FROM settled GROUP BY 1"""),
)
def a19(spark, sf):
    keys = ["prop_date", "market_id", "line", "player_id"]
    b = bets(spark, sf)
    valued = R.clv(b.drop("fair"), b.select(*keys, "fair"), keys, F.lit(0.5), "over_odds")
    valued = valued.withColumns({c: F.round(c, 12) for c in ("model_clv", "execution_clv", "total_clv")})
    out = R.clv_report(valued, ["market_id"])
    return rounded(out, *[c for c in out.columns if "_clv" in c])


@query("a20_bankroll", q(", k AS (SELECT *, row_number() OVER (PARTITION BY market_id, player_id ORDER BY payout DESC, line) AS k FROM settled) SELECT market_id, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, CAST(0 AS BIGINT) AS pushes, CAST(0 AS BIGINT) AS pending, round(sum(profit), 6) AS profit, round(sum(profit) / count(*), 6) AS roi FROM k WHERE k = 1 GROUP BY 1"))
def a20(spark, sf):
    return rounded(R.bankroll(bets(spark, sf), ["player_id"], ["market_id"], [F.desc("payout"), "line"]), "profit", "roi")


@query(
    "a21_kernel_audit",
    "WITH w AS (SELECT exp(-(pow(CAST(embedding[1] AS DOUBLE) - 0.1, 2) + pow(CAST(embedding[2] AS DOUBLE), 2) + pow(CAST(embedding[3] AS DOUBLE) + 0.1, 2)) / (2 * 0.04)) AS w, CAST(label AS DOUBLE) AS x FROM embeddings) SELECT round(sum(w * x) / sum(w), 6) AS mean, round(sum(w * x) / sum(w) - avg(x), 6) AS gap, round(pow(sum(w), 2) / sum(w * w), 6) AS effective_n FROM w",
)
def a21(spark, sf):
    return rounded(R.kernel_audit(table(spark, sf, "embeddings"), "embedding", 3, [0.1, 0.0, -0.1], 0.2, "label"), "mean", "gap", "effective_n")


@query("a22_binomial_pvalue")
def a22(spark, sf):
    g = bets(spark, sf).groupBy("market_id").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "win").alias("wins"))
    return g.withColumn("p_value", O.binomial_tail("wins", "n", 0.524))


@query(
    "a23_lineup_strength",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
       o AS (SELECT *, [1.1, 1.05, 1.0, 0.95, 0.9, 0.85, 0.8][l_linenumber] AS w FROM p WHERE k = 1)
       SELECT l_orderkey, count(*) AS slots, round(CASE WHEN count(q) >= 2 THEN sum(q * CAST(w AS DOUBLE)) / sum(CASE WHEN q IS NOT NULL THEN CAST(w AS DOUBLE) END) END, 6) AS q_weighted, round(CASE WHEN count(q) >= 2 THEN avg(CASE WHEN l_linenumber <= 4 THEN q END) - avg(CASE WHEN l_linenumber > 4 THEN q END) END, 6) AS q_gap FROM o GROUP BY 1 HAVING count(*) >= 3""",
)
def a23(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("q"))
    out = R.lineup_strength(p, ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey", "l_quantity"], ["q"], [1.1, 1.05, 1.0, 0.95, 0.9, 0.85, 0.8], 3, 2)
    return rounded(out, "q_weighted", "q_gap")


@query("a24_park_factor", with_views("SELECT home_team, count(*) AS games, round(avg(home_score + away_score) / (SELECT avg(home_score + away_score) FROM team_game), 6) AS factor FROM team_game GROUP BY 1", "team_game"))
def a24(spark, sf):
    g = view(spark, sf, "team_game").withColumn("runs", F.col("home_score") + F.col("away_score"))
    return rounded(R.park_factor(g, "home_team", "runs"), "factor")


@query("a24_regressed_quality", with_views("SELECT entity_id, count(*) AS n, round(least(count(*) / 30.0, 1) * avg(v_sum) + (1 - least(count(*) / 30.0, 1)) * (SELECT avg(v_sum) FROM entity_day), 6) AS quality FROM entity_day GROUP BY 1", "entity_day"))
def a24b(spark, sf):
    return rounded(R.regressed_quality(view(spark, sf, "entity_day"), "entity_id", "v_sum", 30), "quality")


@query("a25_side_mix", q("SELECT market_id, count(*) AS n, round(avg(CAST(side = 'over' AS INT)), 6) AS over_share, round(avg(profit) FILTER (side = 'over'), 6) AS over_roi, round(avg(profit) FILTER (side = 'under'), 6) AS under_roi FROM settled GROUP BY 1"))
def a25(spark, sf):
    return rounded(R.side_mix(bets(spark, sf), ["market_id"]), "over_share", "over_roi", "under_roi")


@query("a26_bias", q("SELECT CAST(month(prop_date) AS INT) AS month, count(*) AS n, round(avg(market_id - actual), 6) AS bias, round(avg(line - actual), 6) AS market_bias, round(avg(abs(market_id - line)), 6) AS edge, round(avg(CAST(abs(market_id - line) >= 2 AS INT)), 6) AS big_share FROM settled GROUP BY 1"))
def a26(spark, sf):
    b = bets(spark, sf).withColumn("month", F.month("prop_date"))
    return rounded(R.bias_by(b, ["month"], "market_id", "line", "soft_actual", 2), "bias", "market_bias", "edge", "big_share")


@query(
    "a27_holdout",
    q(""", sw AS (SELECT t, avg(profit) AS roi FROM settled JOIN (VALUES (-0.05), (0.0), (0.01), (0.02), (0.03), (0.05)) v(t) ON ev >= t WHERE prop_date < DATE '2024-07-01' GROUP BY t HAVING count(*) >= 5), best AS (SELECT t, roi FROM sw ORDER BY round(roi, 9) DESC, t LIMIT 1)
        SELECT CAST(t AS DOUBLE) AS threshold, round(any_value(roi), 6) AS dev_roi, count(*) AS n, round(avg(profit), 6) AS roi FROM settled JOIN best ON ev >= t WHERE prop_date >= DATE '2024-07-01' GROUP BY t"""),
)
def a27(spark, sf):
    is_dev = F.col("prop_date") < F.lit("2024-07-01").cast("date")
    return rounded(R.select_then_holdout(bets(spark, sf), is_dev, [-0.05, 0.0, 0.01, 0.02, 0.03, 0.05], 5), "dev_roi", "roi")


@query("a28_env_offset", with_views(", k AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY day, game_id) AS k FROM team_game), o AS (SELECT season, avg(home_score - 4.0) AS o FROM k WHERE k <= 100 GROUP BY 1) SELECT game_id, k.season, round(CAST(4.0 + o AS DOUBLE), 6) AS adjusted FROM k JOIN o ON o.season = k.season WHERE k > 100", "team_game"))
def a28(spark, sf):
    g = view(spark, sf, "team_game").withColumn("pred", F.lit(4.0))
    return rounded(R.env_offset(g, "season", ["day", "game_id"], "home_score", "pred", 100).select("game_id", "season", "adjusted"), "adjusted")


@query("m11_kelly_path", q(", l AS (SELECT *, sum(ln(1 + 0.02 * profit)) OVER w AS c FROM settled WINDOW w AS (PARTITION BY market_id ORDER BY prop_date, player_id, line ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY market_id ORDER BY prop_date, player_id, line ROWS UNBOUNDED PRECEDING)) AS pk FROM l) SELECT market_id, count(*) AS n, round(exp(sum(ln(1 + 0.02 * profit))), 6) AS final, round(min(exp(c - pk) - 1), 6) AS worst_fall FROM p GROUP BY 1"))
def m11(spark, sf):
    b = bets(spark, sf).withColumn("stake", F.lit(0.02))
    return rounded(R.kelly_path(b, ["market_id"], ["prop_date", "player_id", "line"], "stake", "profit"), "final", "worst_fall")


@query("t01_board", q("SELECT player_id, line, side, round(ev, 6) AS ev FROM settled WHERE ev >= 0.01 AND player_id >= 10 ORDER BY round(ev, 6) DESC, player_id, line LIMIT 25"))
def t01(spark, sf):
    b = bets(spark, sf).withColumn("ev", r6("ev"))
    return S.board(b, "ev", "player_id", 0.01, 10, 25, ["player_id", "line"]).select("player_id", "line", "side", "ev")


@query("t02_predictions", with_views("SELECT game_id, day, home_team FROM team_game WHERE season = 1995 AND home_team = 7 AND home_score >= 5 ORDER BY day DESC, game_id LIMIT 20", "team_game"))
def t02(spark, sf):
    return S.predictions(view(spark, sf, "team_game"), [F.desc("day"), "game_id"], 20, season=1995, home_team=7, min_home_score=5, max_away_score=None).select("game_id", "day", "home_team")


@query("t03_latest_snapshot", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def t03(spark, sf):
    return S.latest_snapshot(table(spark, sf, "events").withColumn("day", F.to_date("ts")), "day").select("event_id")


@query("u01_team_rows", with_views("SELECT game_id, day, season, home_team AS team, away_team AS opponent, home_score AS score, away_score AS allowed, true AS is_home FROM team_game UNION ALL SELECT game_id, day, season, away_team, home_team, away_score, home_score, false FROM team_game", "team_game"))
def u01(spark, sf):
    return S.team_rows(view(spark, sf, "team_game"))


@query("u02_concat", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def u02(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return S.concat([c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra"))])


@query("u03_dedupe", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def u03(spark, sf):
    return S.dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "u04_append_scheduled",
    with_views(", a AS (SELECT game_id, home_team AS team, day, home_score AS score, false AS is_scheduled FROM team_game UNION ALL SELECT game_id + 1000000, home_team, day + 3, NULL, true FROM team_game WHERE game_id % 10 = 0) SELECT * FROM (SELECT game_id, team, round(avg(score) OVER (PARTITION BY team ORDER BY day, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form, is_scheduled FROM a) WHERE is_scheduled", "team_game"),
)
def u04(spark, sf):
    g = view(spark, sf, "team_game").select("game_id", F.col("home_team").alias("team"), "day", F.col("home_score").alias("score"))
    schedule = g.where("game_id % 10 = 0").select((F.col("game_id") + 1_000_000).alias("game_id"), "team", F.date_add("day", 3).alias("day"))
    all_rows = S.append_scheduled(g, schedule)
    order = ["day", "game_id", "is_scheduled"]  # the id of a scheduled game may be a played one's too, which goes first; the SQL leaves it open
    return all_rows.withColumn("form", r6(W.rolling_rows("team", order, "score", 5))).where("is_scheduled").select("game_id", "team", "form", "is_scheduled")


@query("u05_bet_overlap", with_views(", a AS (SELECT DISTINCT player_id, line, actual > line AS w FROM quotes WHERE book_id = 1), b AS (SELECT DISTINCT player_id, line, actual > line AS w FROM quotes WHERE book_id = 2) SELECT CASE WHEN b.w IS NULL THEN 'only_a' WHEN a.w IS NULL THEN 'only_b' ELSE 'shared' END AS part, count(*) AS n, round(avg(CAST(coalesce(a.w, b.w) AS INT)), 6) AS win_rate FROM a FULL JOIN b ON a.player_id = b.player_id AND a.line = b.line GROUP BY 1", "quotes"))
def u05(spark, sf):
    qs = view(spark, sf, "quotes").withColumn("w", F.col("actual") > F.col("line"))
    pick = lambda b: qs.where(F.col("book_id") == b).select("player_id", "line", "w").distinct()
    return rounded(S.bet_overlap(pick(1), pick(2), ["player_id", "line"], "w"), "win_rate")
