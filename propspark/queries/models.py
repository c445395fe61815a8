"""Models and evaluation loops on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.functions import odds as O
from propspark.operators import models as M
from propspark.queries.registry import query
from propspark.sources.scratch import kept
from propspark.views import league_games, table, view, with_views

r6 = lambda c: F.round(c, 6)


def labelled(spark, sf):
    """Labelled documents with simple features of their texts and a period; a text without characters has no shares.

    Fits pass over them many times, so the texts are read once and the features are kept.
    """
    share = lambda kind: F.try_divide(F.regexp_count("text", F.lit(f"[{kind}]")), F.col("n_chars"))
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"), share("A-Z").alias("upper"), share("|#%*$&!").alias("symbols"))
    s = view(spark, sf, "scored").select("doc_id", "y", "p", "grp")
    return kept(d.join(s, "doc_id").withColumn("period", (F.col("doc_id") % 2).cast("int")), "labelled")


FEATURES = ["size", "upper", "symbols"]


@query("m01_l1_logistic")
def m01(spark, sf):
    d = labelled(spark, sf)
    return M.score(d, M.fit_l1(d.where("period = 0"), FEATURES, "y"), FEATURES, "p_model").select("doc_id", "y", "p_model")


@query("m02_boosted_trees")
def m02(spark, sf):
    d = labelled(spark, sf)
    hard = M.score(d, M.fit_gbt(d.where("period = 0"), FEATURES, "y", trees=5), FEATURES, "p_hard")
    return M.score(hard, M.fit_gbt(d.where("period = 0"), FEATURES, "p", soft=True, trees=5), FEATURES, "p_soft").select("doc_id", "p_hard", "p_soft")


@query("m03_isotonic")
def m03(spark, sf):
    d = labelled(spark, sf)
    return M.fit_isotonic(d.where("period = 0"), "symbols", "y")(d, "calibrated").select("doc_id", "symbols", "calibrated")


@query("m04_counts")
def m04(spark, sf):
    g = view(spark, sf, "team_game").select("game_id", F.col("home_team").cast("double").alias("a"), F.col("away_team").cast("double").alias("b"), "home_score", "season")
    rate = M.score(g, M.fit_poisson(g.where("season < 1996"), ["a", "b"], "home_score"), ["a", "b"], "k9")
    both = M.score(rate, M.fit_linear(g.where("season < 1996"), ["a", "b"], "home_score"), ["a", "b"], "innings")
    return both.select("game_id", "k9", "innings", M.two_stage_count(F.col("k9"), F.col("innings")).alias("k_expected"))


@query("m05_ensemble")
def m05(spark, sf):
    d = labelled(spark, sf)
    model = M.fit_l1(d.where("period = 0"), FEATURES, "y")
    return M.score(d, model, FEATURES, "p_model").select("doc_id", M.ensemble(["p_model", "p"]).alias("p_mean"))


@query(
    "m06_expanding_folds",
    with_views(", c AS (SELECT season, count(*) AS n FROM team_game GROUP BY 1) SELECT a.season AS fold, 'test' AS role, a.n AS n FROM c a WHERE a.season >= 1994 UNION ALL SELECT a.season, 'train', CAST(sum(b.n) AS BIGINT) FROM c a JOIN c b ON b.season < a.season WHERE a.season >= 1994 GROUP BY 1", "team_game"),
)
def m06(spark, sf):
    return M.expanding_folds(view(spark, sf, "team_game"), "season", 0, 1994)


@query("m07_walk_forward_blend")
def m07(spark, sf):
    q = view(spark, sf, "quotes").withColumn("fair", O.devig("over_odds", "under_odds"))
    q = q.withColumn("row_id", F.xxhash64("player_id", "book_id", "line")).withColumn("p_model", 0.35 + (F.col("player_id") % 31) / 100).withColumn("won", (F.col("actual") > F.col("line")).cast("int"))
    return M.walk_forward_blend(q, "prop_date", ["fair", "p_model"], "won", "row_id", 90, 50)


@query("m08_gate")
def m08(spark, sf):
    d = M.add_noise(labelled(spark, sf), 1, 7, "doc_id")
    return M.gate(d, "period", {"candidate": FEATURES, "control": ["size", "noise_0"]}, "y", "p")


@query(
    "m09_distill_set",
    with_views(
        """, d AS (SELECT *, CASE WHEN over_odds > 0 THEN 100.0 / (over_odds + 100) ELSE abs(over_odds) / (abs(over_odds) + 100.0) END AS po, CASE WHEN under_odds > 0 THEN 100.0 / (under_odds + 100) ELSE abs(under_odds) / (abs(under_odds) + 100.0) END AS pu FROM quotes WHERE book_id = 2)
        SELECT player_id, prop_date, round(avg(po / (po + pu)), 6) AS target, count(*) AS n_quotes FROM d GROUP BY 1, 2""",
        "quotes",
    ),
)
def m09(spark, sf):
    q = view(spark, sf, "quotes")
    feats = q.select("player_id", "prop_date").distinct()
    sharp = q.where("book_id = 2").withColumn("fair", O.devig("over_odds", "under_odds"))
    return M.distill_set(feats, sharp, ["player_id", "prop_date"], "fair").withColumn("target", r6("target"))


@query("m10_elo")
def m10(spark, sf):
    return M.elo(league_games(spark, sf), "league", ["day"])


@query("m12_pair_factors")
def m12(spark, sf):
    p = view(spark, sf, "team_game").groupBy("home_team", "away_team").agg(F.avg("home_score").alias("rate"))
    left, right = M.pair_factors(p, "home_team", "away_team", "rate")
    return left.select(F.lit("home").alias("side"), "id", "features").unionByName(right.select(F.lit("away").alias("side"), "id", "features"))


@query("m13_noise")
def m13(spark, sf):
    return M.add_noise(view(spark, sf, "scored").select("doc_id", "y"), 3, 11, "doc_id")
