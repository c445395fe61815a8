"""Row-level operators and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.functions import columns as C
from propspark.functions import odds as O
from propspark.queries.registry import query
from propspark.views import table, view, with_views

r6 = lambda c: F.round(c, 6)


@query("p01_code_flags", "SELECT event_id, lower(event_type) IN ('click','purchase') AS is_action, lower(event_type) IN ('view') AS is_view FROM events")
def p01(spark, sf):
    flags = C.code_flags("event_type", {"is_action": ["click", "purchase"], "is_view": ["view"]})
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("p02_safe_casts", "SELECT c_custkey, TRY_CAST(substr(c_name, 10, 9) AS BIGINT) AS a, TRY_CAST(CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 13, 6) ELSE c_name END AS BIGINT) AS b, round(TRY_CAST(c_acctbal AS DOUBLE), 1) AS bal FROM customer")
def p02(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.safe_int(F.substring("c_name", 10, 9)).alias("a"), C.safe_int(F.when(F.col("c_custkey") % 2 == 0, F.substring("c_name", 13, 6)).otherwise(F.col("c_name"))).alias("b"), C.safe_float(F.col("c_acctbal").cast("string"), 1).alias("bal"))


@query(
    "p03_split_pair",
    "SELECT o_orderkey, CAST(CAST(o_orderkey % 12 AS INT) AS VARCHAR) || '-' || CAST(CAST(o_custkey % 20 AS INT) AS VARCHAR) AS pair, CAST(o_orderkey % 12 AS INT) AS made, CAST(o_custkey % 20 AS INT) AS tried, CAST(o_orderkey % 12 * 12 + o_custkey % 20 AS INT) AS inches FROM orders",
)
def p03(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.concat_ws("-", (F.col("o_orderkey") % 12).cast("string"), (F.col("o_custkey") % 20).cast("string")).alias("pair"))
    made, tried = C.split_pair("pair")
    return df.select("o_orderkey", "pair", made.alias("made"), tried.alias("tried"), C.feet_inches("pair").alias("inches"))


@query("p04_box_order", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS slot, CAST(turn = min(turn) OVER (PARTITION BY conv_id) AS INT) AS is_first FROM conversations")
def p04(spark, sf):
    return C.box_order(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "slot", "is_first")


@query("p04_decision_tag", "SELECT o_orderkey, CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'W' WHEN 1 THEN 'L' WHEN 2 THEN 'S' WHEN 3 THEN 'H' END AS decision FROM orders")
def p04b(spark, sf):
    notes = F.array(*[F.lit(x) for x in ("Smith (W, 3-1)", "Jones (L, 0-2)", "Lee (S, 9)", "Ray (H, 4)", "none")])
    return table(spark, sf, "orders").select("o_orderkey", C.decision_tag(F.get(notes, (F.col("o_custkey") % 5).cast("int"))).alias("decision"))


@query("p05_pair_home_away", with_views("SELECT game_id, home_score, away_score FROM team_game WHERE game_id % 5 <> 0", "team_game"))
def p05(spark, sf):
    from propspark.operators.sets import team_rows

    t = team_rows(view(spark, sf, "team_game")).where("NOT (game_id % 5 = 0 AND is_home)")
    text = F.concat_ws(" ", F.col("team").cast("string"), F.when(F.col("is_home"), "vs.").otherwise("@"), F.col("opponent").cast("string"))
    return C.pair_home_away(t.withColumn("matchup", text), "game_id", "matchup", ["score"])


@query(
    "p06_four_factors",
    with_views(
        """, b AS (SELECT player_id, book_id, line, CAST(player_id % 11 AS DOUBLE) AS fgm, CAST(player_id % 11 + book_id * 3 AS DOUBLE) AS fga, CAST(player_id % 3 AS DOUBLE) AS fg3m, CAST(player_id % 7 AS DOUBLE) AS fta, CAST(book_id AS DOUBLE) AS orb, CAST(player_id % 4 AS DOUBLE) AS tov FROM quotes)
        SELECT player_id, book_id, line, round(fga + 0.44 * fta - orb + tov, 6) AS possessions,
               round(CASE WHEN fga + 0.44 * fta - orb + tov >= 1 THEN 100 * (2 * fgm + fg3m) / (fga + 0.44 * fta - orb + tov) END, 6) AS off_eff,
               round(CASE WHEN fga >= 1 THEN (fgm + 0.5 * fg3m) / fga END, 6) AS efg,
               round(CASE WHEN fga + 0.44 * fta + tov >= 1 THEN tov / (fga + 0.44 * fta + tov) END, 6) AS tov_pct,
               round(CASE WHEN fga >= 1 THEN fta / fga END, 6) AS ft_rate FROM b""",
        "quotes",
    ),
)
def p06(spark, sf):
    d = lambda c: c.cast("double")
    pid, book = F.col("player_id"), F.col("book_id")
    made = C.four_factors(d(pid % 11), d(pid % 11 + book * 3), d(pid % 3), d(pid % 7), d(book), d(pid % 4), d(2 * (pid % 11) + pid % 3))
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", *[r6(c).alias(n) for n, c in made.items()])


@query(
    "p07_innings",
    with_views("SELECT player_id, book_id, line, CAST((player_id % 9) * 3 + player_id % 3 AS BIGINT) AS outs, round(((player_id % 9) * 3 + player_id % 3) / 3.0, 6) AS ip FROM quotes", "quotes"),
)
def p07(spark, sf):
    ip = (F.col("player_id") % 9) + (F.col("player_id") % 3) / 10
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", C.innings_to_outs(ip).alias("outs"), r6(C.true_innings(ip)).alias("ip"))


@query("p08_clamp_odds", with_views("SELECT player_id, book_id, line, CAST(greatest(-120, least(120, over_odds)) AS INT) AS clamped FROM quotes WHERE abs(under_odds) <= 130", "quotes"))
def p08(spark, sf):
    return view(spark, sf, "quotes").where(F.abs("under_odds") <= 130).select("player_id", "book_id", "line", O.clamp_odds("over_odds", 120).alias("clamped"))


@query("p09_half_open_dates", with_views("SELECT kind, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM entity_day WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-20' GROUP BY kind", "entity_day"))
def p09(spark, sf):
    return C.in_window(view(spark, sf, "entity_day"), "day", "2024-01-05", "2024-01-20").groupBy("kind").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))


@query("p10_guarded_ratio", with_views("SELECT entity_id, day, kind, round(CASE WHEN n >= 2 THEN hi / CAST(n AS DOUBLE) END, 6) AS rate FROM entity_day", "entity_day"))
def p10(spark, sf):
    return view(spark, sf, "entity_day").select("entity_id", "day", "kind", r6(C.safe_div("hi", "n", 2)).alias("rate"))


@query("p11_map_codes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'FB' WHEN 'click' THEN 'BR' ELSE 'OS' END AS bucket FROM events")
def p11(spark, sf):
    return table(spark, sf, "events").select("event_id", C.map_codes("event_type", {"view": "FB", "click": "BR"}, "OS").alias("bucket"))


@query(
    "p12_effective_hand",
    """WITH h AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'S' END AS bats, CASE o_orderkey % 2 WHEN 0 THEN 'L' ELSE 'R' END AS throws FROM orders),
       e AS (SELECT *, CASE WHEN bats <> 'S' THEN bats WHEN throws = 'L' THEN 'R' ELSE 'L' END AS hand FROM h)
       SELECT o_orderkey, hand, CAST(hand <> throws AS INT) AS platoon FROM e""",
)
def p12(spark, sf):
    bats = F.when(F.col("o_custkey") % 3 == 0, "L").when(F.col("o_custkey") % 3 == 1, "R").otherwise("S")
    throws = F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("R")
    return table(spark, sf, "orders").select("o_orderkey", C.effective_hand(bats, throws).alias("hand"), C.platoon_advantage(bats, throws).alias("platoon"))


@query(
    "p13_text_flags",
    """WITH w AS (
            SELECT doc_id, CASE WHEN doc_id % 8 = 5 THEN 'None.' ELSE ['Out to left, ', 'In from right, ', 'Clear: ', 'Sunny. ', 'Drizzle, ', '', 'Roof closed, ', 'Calm, '][doc_id % 8 + 1] || text END AS sky,
                   CASE WHEN doc_id % 9 = 0 THEN 'Chase Field' ELSE source END AS venue FROM documents)
       SELECT doc_id, coalesce(contains(lower(sky), 'dome') OR contains(lower(sky), 'roof') OR lower(sky) = 'none.', false) OR coalesce(lower(venue) = 'chase field', false) AS is_dome,
       CASE WHEN starts_with(lower(sky), 'out to') THEN 1 WHEN starts_with(lower(sky), 'in from') THEN -1 WHEN lower(sky) IN ('none.', 'calm.') THEN 0 END AS wind_score,
       starts_with(lower(sky), 'clear') OR starts_with(lower(sky), 'sunny') AS is_clear, regexp_matches(lower(sky), 'rain|drizzle|shower') AS has_rain FROM w""",
)
def p13(spark, sf):
    k = F.col("doc_id") % 8
    starts = F.get(F.array(*map(F.lit, ["Out to left, ", "In from right, ", "Clear: ", "Sunny. ", "Drizzle, ", "", "Roof closed, ", "Calm, "])), k.cast("int"))
    sky = F.when(k == 5, "None.").otherwise(F.concat(starts, "text"))
    venue = F.when(F.col("doc_id") % 9 == 0, "Chase Field").otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in C.weather_flags(sky, venue).items()])


@query(
    "p14_spray",
    with_views(
        """, a AS (SELECT *, degrees(atan2(CAST(player_id % 250 AS DOUBLE) - 125, 199 - CAST(player_id % 180 AS DOUBLE))) AS g, CASE WHEN book_id % 2 = 0 THEN 'L' ELSE 'R' END AS hand FROM quotes)
        SELECT player_id, book_id, line, round(g, 6) AS spray_angle, CASE WHEN hand = 'L' THEN -g ELSE g END < -15 AS pulled, CASE WHEN hand = 'L' THEN -g ELSE g END > 15 AS opposite FROM a""",
        "quotes",
    ),
)
def p14(spark, sf):
    d = lambda c: c.cast("double")
    hand = F.when(F.col("book_id") % 2 == 0, "L").otherwise("R")
    made = C.spray_labels(d(F.col("player_id") % 250), d(F.col("player_id") % 180), hand)
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", r6(made["spray_angle"]).alias("spray_angle"), made["pulled"].alias("pulled"), made["opposite"].alias("opposite"))


@query(
    "p15_weighted_metric",
    with_views(
        """, w AS (SELECT entity_id, sum(CASE WHEN kind = 'view' THEN n END) / CAST(sum(n) AS DOUBLE) AS s1, sum(CASE WHEN kind = 'click' THEN n END) / CAST(sum(n) AS DOUBLE) AS s2,
                sum(CASE WHEN kind = 'view' AND n > 1 THEN v_sum END) / sum(CASE WHEN kind = 'view' AND n > 1 THEN n END) AS m1, sum(CASE WHEN kind = 'click' AND n > 1 THEN v_sum END) / sum(CASE WHEN kind = 'click' AND n > 1 THEN n END) AS m2,
                sum(v_sum) / sum(n) AS f FROM entity_day GROUP BY entity_id)
        SELECT entity_id, round((coalesce(s1 * coalesce(m1, f), 0) + coalesce(s2 * coalesce(m2, f), 0)) / (coalesce(s1, 0) + coalesce(s2, 0)), 6) AS metric FROM w WHERE coalesce(s1, 0) + coalesce(s2, 0) > 0""",
        "entity_day",
    ),
)
def p15(spark, sf):
    ev, many = view(spark, sf, "entity_day"), F.col("n") > 1
    is_ = lambda k: F.col("kind") == k
    share = lambda k: F.sum(F.when(is_(k), F.col("n"))) / F.sum("n")
    metric = lambda k: F.sum(F.when(is_(k) & many, F.col("v_sum"))) / F.sum(F.when(is_(k) & many, F.col("n")))
    wide = ev.groupBy("entity_id").agg(share("view").alias("s1"), share("click").alias("s2"), metric("view").alias("m1"), metric("click").alias("m2"), (F.sum("v_sum") / F.sum("n")).alias("f"))
    f = F.col("f")
    out = wide.select("entity_id", r6(C.weighted_metric([F.col("s1"), F.col("s2")], [F.col("m1"), F.col("m2")], [f, f])).alias("metric"))
    return out.where("metric IS NOT NULL")


@query(
    "p16_expected_pa",
    with_views(
        """, t AS (SELECT player_id, book_id, line, 4.7 - 0.1 * CAST(player_id % 9 + 1 AS DOUBLE) AS total, CAST(player_id % 7 AS DOUBLE) * 4 / 9 AS s FROM quotes)
        SELECT player_id, book_id, line, round(total, 6) AS total_pa, round(s, 6) AS starter_pa, round(greatest(0, total - s) / total, 6) AS bullpen_share FROM t""",
        "quotes",
    ),
)
def p16(spark, sf):
    made = C.expected_pa((F.col("player_id") % 9 + 1).cast("int"), (F.col("player_id") % 7).cast("double"))
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", *[r6(c).alias(n) for n, c in made.items()])


@query(
    "p17_labels",
    with_views(
        """, b AS (SELECT DISTINCT player_id, player_id % 5 AS h, player_id % 2 AS d, player_id % 3 % 2 AS t, player_id % 7 % 2 AS hr, CASE WHEN player_id % 10 = 0 THEN NULL ELSE player_id % 4 END AS r FROM quotes)
        SELECT player_id, h + d + 2 * t + 3 * hr AS tb, h + r AS hr_sum, r IS NOT NULL AS is_valid, CAST(h + d + 2 * t + 3 * hr > 1.5 AS INT) AS over_tb, CAST(h + r > 1.5 AS INT) AS over_sum, CAST(hr >= 1 AS INT) AS any_hr FROM b""",
        "quotes",
    ),
)
def p17(spark, sf):
    p = F.col("player_id")
    b = view(spark, sf, "quotes").select("player_id").distinct().select("player_id", (p % 5).alias("h"), (p % 2).alias("d"), (p % 3 % 2).alias("t"), (p % 7 % 2).alias("hr"), F.when(p % 10 != 0, p % 4).alias("r"))
    tb, both = C.total_bases("h", "d", "t", "hr"), F.col("h") + F.col("r")
    return b.select("player_id", tb.alias("tb"), both.alias("hr_sum"), F.col("r").isNotNull().alias("is_valid"), C.over_line(tb, 1.5).alias("over_tb"), C.over_line(both, 1.5).alias("over_sum"), (F.col("hr") >= 1).cast("int").alias("any_hr"))


@query("p18_differentials", with_views("SELECT game_id, home_score - away_score AS diff_score, away_team - home_team AS diff_team FROM team_game", "team_game"))
def p18(spark, sf):
    return C.differentials(view(spark, sf, "team_game"), [("score", False), ("team", True)]).select("game_id", "diff_score", "diff_team")


@query("p19_feature_columns", with_views("SELECT entity_id, n AS f_n, v_sum AS f_v FROM entity_day", "entity_day"))
def p19(spark, sf):
    df = view(spark, sf, "entity_day").select("entity_id", F.col("n").alias("f_n"), F.col("v_sum").alias("f_v"), F.col("kind").alias("f_kind"), F.col("hi").alias("other"))
    return df.select("entity_id", *C.feature_columns(df, ["f_"]))


@query("p20_ladder", with_views("SELECT player_id, book_id, line, CAST(rung AS DOUBLE) AS rung, CAST(actual > rung AS INT) AS y FROM quotes CROSS JOIN (VALUES (0.5), (1.5), (2.5), (3.5)) r(rung)", "quotes"))
def p20(spark, sf):
    return C.ladder(view(spark, sf, "quotes"), "actual", [0.5, 1.5, 2.5, 3.5]).select("player_id", "book_id", "line", "rung", "y")


@query(
    "p21_zscore_crosses",
    """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
       z AS (SELECT vec_id, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a_z, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b_z FROM v)
       SELECT vec_id, round(a_z, 6) AS a_z, round(b_z, 6) AS b_z, round(a_z * b_z, 6) AS a_z_x_b_z FROM z""",
)
def p21(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    z = C.crosses(C.zscore(v, ["a", "b"]), ["a_z"], ["b_z"])
    return z.select("vec_id", *[r6(F.col(c)).alias(c) for c in ("a_z", "b_z", "a_z_x_b_z")])


@query("p22_clump_filter", with_views("SELECT doc_id, y, grp, p FROM scored WHERE p BETWEEN 0.4 AND 0.6", "scored"))
def p22(spark, sf):
    return C.clump_filter(view(spark, sf, "scored"), "p", 0.4, 0.6)


@query(
    "f01_f03_prices",
    with_views(
        """, d AS (SELECT *, CASE WHEN over_odds > 0 THEN over_odds / 100.0 + 1 ELSE 100.0 / abs(over_odds) + 1 END AS dec_over,
                CASE WHEN over_odds > 0 THEN 100.0 / (over_odds + 100) ELSE abs(over_odds) / (abs(over_odds) + 100.0) END AS p_over, CASE WHEN under_odds > 0 THEN 100.0 / (under_odds + 100) ELSE abs(under_odds) / (abs(under_odds) + 100.0) END AS p_under FROM quotes)
        SELECT player_id, book_id, line, round(dec_over, 6) AS dec_over, round(p_over, 6) AS p_over, round(p_over / (p_over + p_under), 6) AS fair FROM d""",
        "quotes",
    ),
)
def f01(spark, sf):
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", r6(O.decimal_odds("over_odds")).alias("dec_over"), r6(O.implied_probability("over_odds")).alias("p_over"), r6(O.devig("over_odds", "under_odds")).alias("fair"))


EXCHANGE = """, x AS (SELECT player_id, book_id, line, 0.3 + CAST(player_id % 40 AS DOUBLE) / 100 AS last_price, 0.35 + CAST(player_id % 30 AS DOUBLE) / 100 AS oa, 0.4 + CAST(book_id AS DOUBLE) / 10 AS ua FROM quotes)
        SELECT player_id, book_id, line, round(last_price, 6) AS fair_last, round(oa / (oa + ua), 6) AS fair_available, round((oa + 1 - ua) / 2, 6) AS fair_mid FROM x"""


@query("f04_exchange_fair", with_views(EXCHANGE, "quotes"))
def f04(spark, sf):
    p = F.col("player_id")
    last, over, under = 0.3 + (p % 40) / 100, 0.35 + (p % 30) / 100, 0.4 + F.col("book_id") / 10
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", *[r6(O.exchange_fair(last, over, under, how)).alias(f"fair_{how}") for how in ("last", "available", "mid")])


EV_SQL = """, p AS (SELECT *, 0.35 + CAST(player_id % 31 AS DOUBLE) / 100 AS pm, CASE WHEN over_odds > 0 THEN over_odds / 100.0 + 1 ELSE 100.0 / abs(over_odds) + 1 END AS dov, CASE WHEN under_odds > 0 THEN under_odds / 100.0 + 1 ELSE 100.0 / abs(under_odds) + 1 END AS dun FROM quotes),
        e AS (SELECT *, pm * dov - 1 AS eo, (1 - pm) * dun - 1 AS eu FROM p),
        b AS (SELECT *, CASE WHEN eo >= eu THEN 'over' ELSE 'under' END AS side, greatest(eo, eu) AS ev, CASE WHEN eo >= eu THEN dov ELSE dun END AS payout, CASE WHEN eo >= eu THEN pm ELSE 1 - pm END AS p_bet FROM e)
"""


@query("f05_best_side", with_views(EV_SQL + "SELECT player_id, book_id, line, side, round(ev, 6) AS ev, round(eo, 6) AS ev_over, round(eu, 6) AS ev_under, round(payout, 6) AS payout, round(p_bet, 6) AS p_bet FROM b", "quotes"))
def f05(spark, sf):
    made = O.best_side(0.35 + (F.col("player_id") % 31) / 100, "over_odds", "under_odds")
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", *[(c if n == "side" else r6(c)).alias(n) for n, c in made.items()])


@query(
    "f06_settle",
    with_views(
        EV_SQL
        + """, s AS (SELECT *, floor(line) AS whole FROM b), r AS (SELECT *, CASE WHEN actual = whole THEN 'push' WHEN (side = 'over') = (actual > whole) THEN 'win' ELSE 'loss' END AS result FROM s)
        SELECT player_id, book_id, line, side, result, round(CASE result WHEN 'win' THEN payout - 1 WHEN 'loss' THEN -1 ELSE 0 END, 6) AS profit FROM r""",
        "quotes",
    ),
)
def f06(spark, sf):
    q = view(spark, sf, "quotes").withColumns(O.best_side(0.35 + (F.col("player_id") % 31) / 100, "over_odds", "under_odds"))
    q = q.withColumn("result", O.outcome("side", "actual", F.floor("line")))
    return q.select("player_id", "book_id", "line", "side", "result", r6(O.profit("result", "payout")).alias("profit"))


@query(
    "f07_two_step_gate",
    with_views(
        """, d AS (SELECT *, CASE WHEN over_odds > 0 THEN 100.0 / (over_odds + 100) ELSE abs(over_odds) / (abs(over_odds) + 100.0) END AS po, CASE WHEN under_odds > 0 THEN 100.0 / (under_odds + 100) ELSE abs(under_odds) / (abs(under_odds) + 100.0) END AS pu, 0.35 + CAST(player_id % 31 AS DOUBLE) / 100 AS pm FROM quotes),
        g AS (SELECT prop_date, market_id, player_id, line, median(po / (po + pu)) AS fair, max(over_odds) AS best, any_value(pm) AS pm FROM d GROUP BY 1, 2, 3, 4)
        SELECT player_id, line, round(fair, 6) AS fair, pm - fair >= 0.03 AND pm > CASE WHEN best > 0 THEN 100.0 / (best + 100) ELSE abs(best) / (abs(best) + 100.0) END AS passes FROM g""",
        "quotes",
    ),
)
def f07(spark, sf):
    q = view(spark, sf, "quotes").withColumn("fair", O.devig("over_odds", "under_odds"))
    g = q.groupBy("prop_date", "market_id", "player_id", "line").agg(F.percentile("fair", F.lit(0.5)).alias("fair"), F.max("over_odds").alias("best"))
    gate = O.two_step_gate(0.35 + (F.col("player_id") % 31) / 100, "fair", "best", 0.03)
    return g.select("player_id", "line", r6(F.col("fair")).alias("fair"), gate.alias("passes"))


@query("f08_side_shade", with_views("SELECT game_id, season, round(0.5 - CASE season WHEN 1993 THEN 0.02 WHEN 1995 THEN 0.01 ELSE 0 END, 6) AS p FROM team_game", "team_game"))
def f08(spark, sf):
    return view(spark, sf, "team_game").select("game_id", "season", r6(O.side_shade(F.lit(0.5), "season", {1993: 0.02, 1995: 0.01})).alias("p"))


@query("f09_normal_tail")
def f09(spark, sf):
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", O.normal_tail("line", "actual", F.lit(1.5)).alias("p_over"))


@query(
    "f10_poisson_tail",
    with_views(
        """, q AS (SELECT player_id, book_id, line, actual + 0.25 AS m FROM quotes)
        SELECT player_id, book_id, line, round(1 - exp(-m) * list_sum(list_transform(range(CAST(floor(line) AS BIGINT) + 1), lambda k: pow(m, k) / factorial(CAST(k AS INT)))), 6) AS p_over FROM q""",
        "quotes",
    ),
)
def f10(spark, sf):
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", r6(O.poisson_tail("line", F.col("actual") + 0.25)).alias("p_over"))


@query(
    "f11_negative_binomial_tail",
    with_views(
        """, q AS (SELECT player_id, book_id, line, actual + 0.25 AS m FROM quotes)
        SELECT player_id, book_id, line, round(1 - list_sum(list_transform(range(CAST(floor(line) AS BIGINT) + 1), lambda k: gamma(k + 3.0) / (gamma(3.0) * factorial(CAST(k AS INT))) * pow(3.0 / (m + 3), 3) * pow(m / (m + 3), k))), 6) AS p_over FROM q""",
        "quotes",
    ),
)
def f11(spark, sf):
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", r6(O.negative_binomial_tail("line", F.col("actual") + 0.25, F.lit(3.0))).alias("p_over"))


@query(
    "f12_rates",
    with_views(
        """, c AS (SELECT DISTINCT player_id, CAST(player_id % 50 + 20 AS DOUBLE) AS ab, CAST(player_id % 15 + 6 AS DOUBLE) AS h, CAST(player_id % 4 AS DOUBLE) AS d, CAST(player_id % 2 AS DOUBLE) AS t, CAST(player_id % 3 AS DOUBLE) AS hr, CAST(player_id % 9 AS DOUBLE) AS bb, CAST(player_id % 6 AS DOUBLE) AS ip FROM quotes)
        SELECT player_id, round(h / ab, 6) AS avg, round((h + bb + 1) / (ab + bb + 1 + 2), 6) AS obp, round((h - d - t - hr + 2 * d + 3 * t + 4 * hr) / ab, 6) AS slg,
               round((h + bb + 1) / (ab + bb + 3) + (h + d + 2 * t + 3 * hr) / ab, 6) AS ops, round((d + 2 * t + 3 * hr) / ab, 6) AS iso,
               round((0.69 * bb + 0.72 + 0.89 * (h - d - t - hr) + 1.27 * d + 1.62 * t + 2.1 * hr) / (ab + bb + 3), 6) AS woba,
               round(CASE WHEN ip > 0 THEN (13 * hr + 3 * bb - 2 * d) / ip + 3.1 END, 6) AS fip, round(CASE WHEN ip > 0 THEN 9 * d / ip END, 6) AS k9, round(CASE WHEN ip > 0 THEN (bb + h) / ip END, 6) AS whip FROM c""",
        "quotes",
    ),
)
def f12(spark, sf):
    x = lambda c: c.cast("double")
    p, one = F.col("player_id"), F.lit(1.0)
    h, d, hr, bb = x(p % 15 + 6), x(p % 4), x(p % 3), x(p % 9)
    rates = C.baseball_rates(h=h, d=d, t=x(p % 2), hr=hr, bb=bb, hbp=one, so=d, ab=x(p % 50 + 20), sf=F.lit(2.0), ip=x(p % 6), ha=h, bba=bb, hra=hr, soa=d)
    return view(spark, sf, "quotes").select("player_id").distinct().select("player_id", *[r6(c).alias(n) for n, c in rates.items()])


@query("f13_elo_terms", with_views("SELECT game_id, round(1 / (1 + pow(10.0, (away_team * 10 - home_team * 10) / 400.0)), 6) AS p_home, round(CASE WHEN home_score = away_score THEN 1.0 ELSE ln(1 + abs(home_score - away_score)) END, 6) AS mult FROM team_game", "team_game"))
def f13(spark, sf):
    return view(spark, sf, "team_game").select("game_id", r6(O.elo_expectation(F.col("home_team") * 10, F.col("away_team") * 10)).alias("p_home"), r6(O.margin_multiplier(F.col("home_score") - F.col("away_score"))).alias("mult"))


@query("f14_kelly", with_views(EV_SQL + "SELECT player_id, book_id, line, round(greatest(0, (p_bet * (payout - 1) - (1 - p_bet)) / (payout - 1)), 6) AS kelly, round(least(0.03, greatest(0, (p_bet * (payout - 1) - (1 - p_bet)) / (payout - 1)) * 0.25), 6) AS stake FROM b", "quotes"))
def f14(spark, sf):
    q = view(spark, sf, "quotes").withColumns(O.best_side(0.35 + (F.col("player_id") % 31) / 100, "over_odds", "under_odds"))
    return q.select("player_id", "book_id", "line", r6(O.kelly_fraction("p_bet", "payout")).alias("kelly"), r6(O.kelly_fraction("p_bet", "payout", 0.25, 0.03)).alias("stake"))


@query("f15_json_rate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, round(CASE WHEN value > 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / value END, 4) AS k_rate FROM events")
def f15(spark, sf):
    return table(spark, sf, "events").select("event_id", C.json_number("props", "$.k").alias("k"), F.round(C.json_number("props", "$.k", "value"), 4).alias("k_rate"))


@query("f16_local_time", "SELECT event_id, CAST(ts - INTERVAL 5 HOURS AS DATE) AS local_date, CAST(hour(ts - INTERVAL 5 HOURS) AS INT) AS local_hour FROM events")
def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in C.local_time("ts", "-05:00").items()])


@query("f17_clock", "SELECT o_orderkey, CAST(o_orderkey % 12 * 60 + o_custkey % 60 AS INT) AS seconds, CAST(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey % 5 END AS INT) AS margin FROM orders")
def f17(spark, sf):
    clock = F.concat_ws(":", (F.col("o_orderkey") % 12).cast("string"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))
    margin = F.when(F.col("o_custkey") % 5 == 0, "TIE").otherwise((F.col("o_custkey") % 5).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", C.clock_seconds(clock).alias("seconds"), C.score_margin(margin).alias("margin"))


@query("f18_display_key", with_views("SELECT player_id, book_id, line, CAST(player_id AS VARCHAR) || '|' || CAST(market_id AS VARCHAR) || '|' || CAST(line AS VARCHAR) AS key FROM quotes", "quotes"))
def f18(spark, sf):
    return view(spark, sf, "quotes").select("player_id", "book_id", "line", C.display_key("player_id", "market_id", "line").alias("key"))
