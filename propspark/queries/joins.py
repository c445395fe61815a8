"""Joins and entity resolution on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.operators import joins as J
from propspark.operators import names as N
from propspark.queries.registry import query
from propspark.sources import io as IO
from propspark.sources.scratch import shared_path
from propspark.views import table, view, with_views

r6 = lambda c: F.round(c, 6)


@query("j01_enrich", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j01(spark, sf):
    c, n = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.enrich(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), [(c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey")]).select("o_orderkey", "c_mktsegment", "n_name")


@query("j02_companion", "SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(l_quantity * o_totalprice), 2) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j02(spark, sf):
    """Both facts are written in buckets of the order once; their join and the sums by order then run without a shuffle."""
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    path = shared_path(spark, "companion")
    tag = path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = (IO.save_bucketed(df, f"companion_{n}_{tag}", f"{path}/{n}", ["l_orderkey"], buckets) for n, df in (("lines", a), ("orders", b)))
    met = J.join_companion(a, b, ["l_orderkey"])
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("o_totalprice")), 2).alias("x"))


@query("j03_opponent", with_views("SELECT game_id, home_team AS team, away_team AS opp_team, away_score AS opp_score FROM team_game WHERE home_team <> away_team UNION ALL SELECT game_id, away_team, home_team, home_score FROM team_game WHERE home_team <> away_team", "team_game"))
def j03(spark, sf):
    from propspark.operators.sets import team_rows

    t = team_rows(view(spark, sf, "team_game").where("home_team <> away_team"))
    return J.attach_opponent(t.select("game_id", "team"), t, "game_id", "team", ["team", "score"])


ASOF = "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS view_id, user_id, ts, value FROM events WHERE event_type = 'view') SELECT event_id, (SELECT arg_max(view_id, (r.ts, r.view_id)) FROM r WHERE r.user_id = l.user_id AND r.ts {} l.ts) AS view_id FROM l"


def _asof(spark, sf, strict):
    e = table(spark, sf, "events").withColumn("ts", F.date_trunc("hour", "ts")) if strict is None else table(spark, sf, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts", F.col("event_id").alias("order_id"))
    return J.asof(left, right, "user_id", "ts", ["view_id"], strict=bool(strict), tie="order_id").select("event_id", "view_id")


@query("j04_asof", ASOF.format("<="))
def j04(spark, sf):
    return _asof(spark, sf, False)


@query("j05_asof_strict", ASOF.format("<"))
def j05(spark, sf):
    return _asof(spark, sf, True)


@query(
    "j06_nearest",
    with_views(
        """, a AS (SELECT * FROM snap WHERE source = 'view'), b AS (SELECT * FROM snap WHERE source = 'click'),
        m AS (SELECT a.quote_id, b.quote_id AS near_quote_id, abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) AS gap, row_number() OVER (PARTITION BY a.quote_id ORDER BY abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)), b.quote_id) AS k
              FROM a JOIN b ON a.prop_id = b.prop_id AND abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) <= 1200000000)
        SELECT quote_id, near_quote_id, round(gap / 1000000.0, 6) AS gap_seconds FROM m WHERE k = 1""",
        "snap",
    ),
)
def j06(spark, sf):
    s = view(spark, sf, "snap")
    out = J.nearest(s.where("source = 'view'"), s.where("source = 'click'"), "prop_id", "captured_at", 1200, "quote_id", ["quote_id"], "quote_id")
    return out.select("quote_id", "near_quote_id", r6("gap_seconds").alias("gap_seconds"))


@query("j07_two_books", with_views("SELECT a.player_id, a.line, a.over_odds AS soft_over_odds, b.over_odds AS sharp_over_odds FROM quotes a JOIN quotes b ON a.prop_date = b.prop_date AND a.market_id = b.market_id AND a.line = b.line AND a.player_id = b.player_id WHERE a.book_id = 1 AND b.book_id = 2", "quotes"))
def j07(spark, sf):
    return J.overlap(view(spark, sf, "quotes"), 1, 2, ["prop_date", "market_id", "line", "player_id"], "book_id", ["over_odds"]).select("player_id", "line", "soft_over_odds", "sharp_over_odds")


@query(
    "j08_prior_days",
    with_views(", d AS (SELECT entity_id, day, sum(n) AS n FROM entity_day GROUP BY 1, 2) SELECT d.entity_id, d.day, CAST(coalesce(a.n, 0) AS BIGINT) AS n_1, CAST(coalesce(b.n, 0) AS BIGINT) AS n_2, CAST(coalesce(c.n, 0) AS BIGINT) AS n_3 FROM d LEFT JOIN d a ON a.entity_id = d.entity_id AND a.day = d.day - 1 LEFT JOIN d b ON b.entity_id = d.entity_id AND b.day = d.day - 2 LEFT JOIN d c ON c.entity_id = d.entity_id AND c.day = d.day - 3", "entity_day"),
)
def j08(spark, sf):
    d = view(spark, sf, "entity_day").groupBy("entity_id", "day").agg(F.sum("n").alias("n"))
    return J.prior_days(d.select("entity_id", "day"), d, "entity_id", "day", "n", [1, 2, 3])


@query("j09_semi_anti", "SELECT 'with' AS part, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j09(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda df, part: df.groupBy().agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count(J.semi(c, o, "c_custkey"), "with").unionByName(count(J.anti(c, o, "c_custkey"), "without"))


@query("j10_outer_merge", with_views(", a AS (SELECT entity_id, sum(n) AS views FROM entity_day WHERE kind = 'view' GROUP BY 1), b AS (SELECT entity_id, sum(n) AS clicks, max(v_sum) AS top FROM entity_day WHERE kind = 'click' AND n > 1 GROUP BY 1) SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CAST(coalesce(views, 0) AS BIGINT) AS views, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks, top FROM a FULL JOIN b ON a.entity_id = b.entity_id", "entity_day"))
def j10(spark, sf):
    e = view(spark, sf, "entity_day")
    a = e.where("kind = 'view'").groupBy("entity_id").agg(F.sum("n").alias("views"))
    b = e.where("kind = 'click' AND n > 1").groupBy("entity_id").agg(F.sum("n").alias("clicks"), F.max("v_sum").alias("top"))
    return J.outer_merge([a, b], "entity_id", ["views", "clicks"])


BETS = ", {0} AS (SELECT player_id, line, CASE WHEN over_odds > under_odds THEN 'over' ELSE 'under' END AS side, CASE WHEN (actual > line) = (over_odds > under_odds) THEN 0.9 ELSE -1.0 END AS p FROM quotes WHERE book_id = {1} AND player_id % {2} <> 0)"


def _bets(spark, sf, book, skip):
    q = view(spark, sf, "quotes").where((F.col("book_id") == book) & (F.col("player_id") % skip != 0))
    over = F.col("over_odds") > F.col("under_odds")
    return q.select("player_id", "line", F.when(over, "over").otherwise("under").alias("side"), F.when((F.col("actual") > F.col("line")) == over, 0.9).otherwise(-1.0).alias("p"))


@query(
    "j11_paired_decomposition",
    with_views(
        BETS.format("a", 1, 3) + BETS.format("b", 2, 5) + " SELECT CASE WHEN b.side IS NULL THEN 'only_a' WHEN a.side IS NULL THEN 'only_b' WHEN a.side = b.side THEN 'common' ELSE 'flipped' END AS part, count(*) AS n, round(CAST(avg(a.p) AS DOUBLE), 6) AS mean_a, round(CAST(avg(b.p) AS DOUBLE), 6) AS mean_b FROM a FULL JOIN b ON a.player_id = b.player_id AND a.line = b.line GROUP BY 1",
        "quotes",
    ),
)
def j11(spark, sf):
    out = J.paired_decomposition(_bets(spark, sf, 1, 3), _bets(spark, sf, 2, 5), ["player_id", "line"], "side", "p")
    return out.select("part", "n", r6("mean_a").alias("mean_a"), r6("mean_b").alias("mean_b"))


@query("j12_opponent_window", with_views("SELECT game_id, home_team AS team, home_score AS score, away_score AS opp_score FROM team_game WHERE home_team <> away_team UNION ALL SELECT game_id, away_team, away_score, home_score FROM team_game WHERE home_team <> away_team", "team_game"))
def j12(spark, sf):
    from propspark.operators.sets import team_rows

    t = team_rows(view(spark, sf, "team_game").where("home_team <> away_team")).select("game_id", "team", "score")
    return J.with_opponent(t, "game_id", "team", ["score"])


@query("j13_prior_season", with_views(", a AS (SELECT home_team, season, round(avg(home_score), 6) AS mean_score FROM team_game GROUP BY 1, 2) SELECT g.game_id, a.mean_score FROM team_game g LEFT JOIN a ON a.home_team = g.home_team AND a.season = g.season - 1", "team_game"))
def j13(spark, sf):
    g = view(spark, sf, "team_game")
    return J.prior_season(g, g.groupBy("home_team", "season").agg(r6(F.avg("home_score")).alias("mean_score")), "home_team", "season").select("game_id", "mean_score")


@query("j14_home_away", with_views("SELECT game_id, h.n_name AS home_n_name, a.n_name AS away_n_name, coalesce(CASE WHEN game_id % 3 = 0 THEN NULL ELSE h.n_name END, a.n_name) AS starter FROM team_game LEFT JOIN nation h ON h.n_nationkey = home_team LEFT JOIN nation a ON a.n_nationkey = away_team", "team_game"))
def j14(spark, sf):
    out = J.home_away_view(view(spark, sf, "team_game"), table(spark, sf, "nation"), "n_nationkey", ["n_name"])
    actual = F.when(F.col("game_id") % 3 != 0, F.col("home_n_name"))
    return out.select("game_id", "home_n_name", "away_n_name", J.actual_or_probable(actual, F.col("away_n_name")).alias("starter"))


@query("j15_agreement", with_views(BETS.format("a", 1, 3) + BETS.format("b", 2, 5) + " SELECT a.side = b.side AS agrees, count(*) AS n, round(CAST(avg(a.p) AS DOUBLE), 6) AS roi FROM a JOIN b ON a.player_id = b.player_id AND a.line = b.line GROUP BY 1", "quotes"))
def j15(spark, sf):
    return J.agreement_split(_bets(spark, sf, 1, 3), _bets(spark, sf, 2, 5), ["player_id", "line"], "side", "p").select("agrees", "n", r6("roi").alias("roi"))


@query("j16_compare_sources", with_views("SELECT count(*) AS n, round(avg(abs(a.over_odds - b.over_odds)), 6) AS mean_diff, CAST(median(abs(a.over_odds - b.over_odds)) AS DOUBLE) AS median_diff, max(abs(a.over_odds - b.over_odds)) AS max_diff FROM quotes a JOIN quotes b ON a.player_id = b.player_id AND a.line = b.line WHERE a.book_id = 1 AND b.book_id = 2", "quotes"))
def j16(spark, sf):
    q = view(spark, sf, "quotes")
    out = J.compare_sources(q.where("book_id = 1"), q.where("book_id = 2"), ["player_id", "line"], "over_odds")
    return out.withColumn("mean_diff", r6("mean_diff"))


def norm_sql(name: str) -> str:
    """normalize_name() in DuckDB."""
    folded = f"regexp_replace(lower(strip_accents({name})), '[^\\x00-\\x7f]', '', 'g')"
    bare = rf"regexp_replace(regexp_replace({folded}, '\b(jr|sr|ii|iii|iv)\b\.?', ' ', 'g'), '[^a-z0-9 \s]', '', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


@query("e01_normalize_name", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def e01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.normalize_name("text").alias("norm"))


@query(
    "e02_match_unique",
    f"""WITH d AS (
            SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Nation ' || c_nationkey ELSE c_name END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' Jr.' END AS name FROM customer),
        n AS (SELECT c_custkey, {norm_sql('name')} AS norm FROM d),
        u AS (SELECT norm, min(c_custkey) AS id FROM n GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1)
        SELECT n.c_custkey, n.norm, u.id AS matched FROM n LEFT JOIN u ON u.norm = n.norm""",
)
def e02(spark, sf):
    """A fifth of the customers share the name of their nation, so that names are both unique and ambiguous."""
    shared = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Nation "), "c_nationkey")).otherwise(F.col("c_name"))
    d = table(spark, sf, "customer").select("c_custkey", F.concat(shared, F.when(F.col("c_custkey") % 7 == 0, "").otherwise(" Jr.")).alias("name"))
    d = d.withColumn("norm", N.normalize_name("name"))
    return N.match_unique(d.select("c_custkey", "norm"), d.select(F.col("c_custkey").alias("id"), "norm"), "norm", "id").select("c_custkey", "norm", F.col("id").alias("matched"))


@query(
    "e03_fuzzy_match",
    """WITH l AS (SELECT DISTINCT 'the ' || lower(n_name) || ' team' AS name FROM nation UNION SELECT lower(substr(r_name, 1, 4)) FROM region), d AS (SELECT n_nationkey AS id, lower(n_name) AS dim FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name) FROM region),
       m AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = dim THEN 0 WHEN contains(name, dim) THEN 1 ELSE 2 END, id) AS k FROM l JOIN d ON name = dim OR contains(name, dim) OR contains(dim, name)) SELECT name, id FROM m WHERE k = 1""",
)
def e03(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    left = nation.select(F.concat(F.lit("the "), F.lower("n_name"), F.lit(" team")).alias("name")).union(region.select(F.lower(F.substring("r_name", 1, 4)))).distinct()
    dim = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("dim")).union(region.select((F.col("r_regionkey") + 100).cast("long"), F.lower("r_name")))
    return N.fuzzy_match(left, dim, "name", "dim", "id").select("name", "id")


@query(
    "e04_infer_market",
    with_views(
        """, s AS (SELECT market_id, actual, CAST(player_id * 13 % 7 AS DOUBLE) AS a, CAST(player_id % 7 AS DOUBLE) AS b, CAST(player_id % 3 AS DOUBLE) AS c FROM quotes),
        r AS (SELECT market_id, 'a' AS stat, avg(CAST(actual = a AS INT)) AS rate FROM s GROUP BY 1 UNION ALL SELECT market_id, 'b', avg(CAST(actual = b AS INT)) FROM s GROUP BY 1 UNION ALL SELECT market_id, 'c', avg(CAST(actual = c AS INT)) FROM s GROUP BY 1)
        SELECT market_id, arg_min(stat, (-rate, stat)) AS stat, round(max(rate), 6) AS rate FROM r GROUP BY 1""",
        "quotes",
    ),
)
def e04(spark, sf):
    p = F.col("player_id")
    s = view(spark, sf, "quotes").select("market_id", "actual", (p * 13 % 7).cast("double").alias("a"), (p % 7).cast("double").alias("b"), (p % 3).cast("double").alias("c"))
    return N.infer_market(s, "market_id", "actual", ["a", "b", "c"]).select("market_id", "stat", r6("rate").alias("rate"))


@query(
    "e05_dual_date",
    with_views(
        """, r AS (SELECT home_team, day, max(game_id) AS right_id FROM team_game WHERE game_id % 2 = 0 GROUP BY 1, 2), l AS (SELECT game_id, home_team, day FROM team_game WHERE game_id % 2 = 1),
        m AS (SELECT l.game_id, r.right_id, row_number() OVER (PARTITION BY l.game_id ORDER BY CASE WHEN r.day = l.day THEN 0 WHEN r.day = l.day + 1 THEN 1 ELSE 2 END, r.right_id) AS k, CASE WHEN r.day = l.day THEN 0 WHEN r.day = l.day + 1 THEN 1 ELSE 2 END AS s FROM l JOIN r ON l.home_team = r.home_team AND abs(l.day - r.day) <= 1)
        SELECT game_id, CAST(s AS INT) AS shift_rank, right_id FROM m WHERE k = 1""",
        "team_game",
    ),
)
def e05(spark, sf):
    g = view(spark, sf, "team_game")
    right = g.where("game_id % 2 = 0").groupBy("home_team", "day").agg(F.max("game_id").alias("right_id"))
    return J.dual_date_join(g.where("game_id % 2 = 1").select("game_id", "home_team", "day"), right, "home_team", "day", "game_id", ["right_id"], "right_id").select("game_id", "shift_rank", "right_id")
