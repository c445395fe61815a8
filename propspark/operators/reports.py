"""Aggregations and reports over quotes, bets, predictions and games.

Thresholds, bins and segments multiply rows only before a partial aggregation; totals that
one row holds are broadcast, everything else is left to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.functions import odds as O
from propspark.operators import windows as W
from propspark.operators.ordered import chunked, order_statistics, running


def pair_counts(df: DataFrame, keys: list[str], column: str, patterns: dict[str, str]) -> DataFrame:
    """Rows per keys, and those whose text matches each pattern without regard to case."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(column).ilike(p)).alias(n) for n, p in patterns.items()])


def distinct_per(df: DataFrame, keys: list[str], columns: list[str], approximate: bool = False) -> DataFrame:
    if approximate:
        return df.groupBy(*keys).agg(F.approx_count_distinct(F.struct(*columns)).alias("n_distinct"))
    return df.groupBy(*keys).agg(F.count_distinct(*columns).alias("n_distinct"))


def rate_vs_league(df: DataFrame, key: str, num: str, den: str, min_den: float) -> DataFrame:
    """Static: an entity's rate less that of all rows, for entities with enough of them."""
    league = df.agg((F.sum(num) / F.sum(den)).alias("_league"))
    own = df.groupBy(key).agg(F.sum(num).alias("_num"), F.sum(den).alias("n")).where(F.col("n") >= min_den)
    return own.join(F.broadcast(league)).select(key, "n", (F.col("_num") / F.col("n") - F.col("_league")).alias("rate_gap"))


def line_dispersion(quotes: DataFrame, game: list[str], line: str, book: str) -> DataFrame:
    return quotes.groupBy(*game).agg(F.count_distinct(book).alias("books"), (F.max(line) - F.min(line)).alias("spread"), F.stddev_pop(line).alias("sd"))


def consensus_line(quotes: DataFrame, game: list[str], line: str) -> DataFrame:
    """(game, line, n): the line with most quotes, the smaller one on a tie."""
    counted = quotes.groupBy(*game, line).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(line, "n"), F.struct((-F.col("n")).alias("a"), F.col(line).alias("b")))
    return counted.groupBy(*game).agg(best.alias("_b")).select(*game, f"_b.{line}", "_b.n")


def price_summary(quotes: DataFrame, game: list[str], price: str, book: str) -> DataFrame:
    """Best, median and worst price, number of books, and the book with the best price (the smallest on a tie)."""
    return quotes.groupBy(*game).agg(
        F.max(price).alias("best"),
        F.percentile(price, F.lit(0.5)).alias("median"),
        F.min(price).alias("worst"),
        F.count_distinct(book).alias("books"),
        F.min_by(book, F.struct((-F.col(price)).alias("a"), F.col(book).alias("b"))).alias("best_book"),
    )


def by_priority(quotes: DataFrame, game: list[str], book: str, order: list, columns: list[str]) -> DataFrame:
    """Each game's columns from the book that stands first in `order`; others are not used."""
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(book))
    best = F.min_by(F.struct(book, *columns), rank)
    return quotes.where(rank > 0).groupBy(*game).agg(best.alias("_b")).select(*game, "_b.*")


def pivot_sides(options: DataFrame, keys: list[str], side: str, value: str, sides: list[str]) -> DataFrame:
    """One row per key with a column per side, only keys that have them all."""
    wide = options.groupBy(*keys).agg(*[F.max(F.when(F.col(side) == s, F.col(value))).alias(s) for s in sides])
    return wide.dropna(subset=sides)


def bucket(column: Column, edges: list[float], right_closed: bool = True) -> Column:
    """Number of the bin (from 1) between sorted edges; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False), 1))):
        inside = (column > a) & (column <= b) if right_closed else (column >= a) & (column < b)
        out = F.when(inside, i).otherwise(out)
    return out


def bucket_report(bets: DataFrame, column: str, edges: list[float], result: str, profit: str) -> DataFrame:
    b = bets.withColumn("bucket", bucket(F.col(column), edges)).where("bucket IS NOT NULL")
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg((F.col(result) == "win").cast("int")).alias("hit"), F.avg(profit).alias("roi"))


def segments(df: DataFrame, column: str, shares: dict[str, tuple[float, float]], value: str) -> DataFrame:
    """(segment, n, mean): rows between exact quantiles of a column; a row may lie in several segments."""
    points = sorted({q for pair in shares.values() for q in pair})
    found = order_statistics(df, [], column, points).get((), [None] * len(points))
    at = dict(zip(points, (F.lit(v).cast("double") for v in found), strict=True))
    names = F.array_compact(F.array(*[F.when(F.col(column).between(at[a], at[b]), F.lit(n)) for n, (a, b) in shares.items()]))
    return df.select(F.explode(names).alias("segment"), value).groupBy("segment").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def market_gap(df: DataFrame, by: list[str], hit: str, implied: str) -> DataFrame:
    """Hit rate less implied probability, its binomial standard error and z."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("_a"), F.avg(implied).alias("_p"))
    se = F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("n"))
    return g.select(*by, "n", (F.col("_a") - F.col("_p")).alias("gap"), se.alias("se"), ((F.col("_a") - F.col("_p")) / se).alias("z"))


def price_bets(quotes: DataFrame, p_over: Column, over: str, under: str, actual: str, line: str) -> DataFrame:
    """Quotes with both expected values, the better side, its result and its profit per unit."""
    priced = quotes.withColumns(O.best_side(p_over, over, under))
    priced = priced.withColumn("result", O.outcome("side", actual, line))
    return priced.withColumn("profit", O.profit("result", "payout"))


def threshold_sweep(bets: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Per threshold of ev: bets, hit rate, return, total, share of overs and bets per day.

    A row is offered only to thresholds at or below its ev, and summed before the shuffle.
    """
    by = by or []
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("ev") >= t)
    long = bets.select(*by, F.explode(reached).alias("threshold"), "prop_date", "side", "result", "profit")
    daily = long.groupBy(*by, "threshold", "prop_date").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "win").alias("wins"), F.sum("profit").alias("profit"), F.count_if(F.col("side") == "over").alias("overs"))
    out = daily.groupBy(*by, "threshold").agg(F.sum("n").alias("n"), F.sum("wins").alias("_w"), F.sum("profit").alias("total"), F.sum("overs").alias("_o"), F.count("*").alias("_d"))
    return out.select(*by, "threshold", "n", (F.col("_w") / F.col("n")).alias("hit"), (F.col("total") / F.col("n")).alias("roi"), "total", (F.col("_o") / F.col("n")).alias("over_share"), (F.col("n") / F.col("_d")).alias("per_day"))


def market_report(bets: DataFrame, market: str) -> DataFrame:
    """(market, is_total, n, hit, roi) for every market and all of them."""
    return bets.rollup(market).agg(F.grouping(market).cast("int").alias("is_total"), F.count("*").alias("n"), F.avg((F.col("result") == "win").cast("int")).alias("hit"), F.avg("profit").alias("roi"))


def daily_sharpe(bets: DataFrame, day: str, by: list[str]) -> DataFrame:
    """Mean of daily sums over their sample deviation."""
    daily = bets.groupBy(*by, day).agg(F.sum("profit").alias("_p"))
    return daily.groupBy(*by).agg(F.count("*").alias("days"), F.sum("_p").alias("total"), (F.avg("_p") / F.nullif(F.stddev_samp("_p"), F.lit(0.0))).alias("sharpe"))


def roi_se(bets: DataFrame, by: list[str], min_n: int) -> DataFrame:
    g = bets.groupBy(*by).agg(F.count("*").alias("n"), F.avg("profit").alias("roi"), (2 * F.stddev_samp("profit") / F.sqrt(F.count("*"))).alias("two_se"))
    return g.where(F.col("n") >= min_n)


def calibration(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Left-closed bins of equal width: number, mean prediction, rate and their difference. Rows without a prediction have the null bin."""
    b = F.when(F.col(p).isNotNull(), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("actual"))
    return g.withColumn("diff", F.col("actual") - F.col("predicted"))


def binary_metrics(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Exact AUC with ties (null for one class), Brier score, log loss, accuracy, MAE, RMSE, correlation.

    Rows are first counted by score; the negatives below a score are a running sum over ranges
    of scores, so one group, too, is spread over tasks.
    """
    q = F.when(F.col(p).isNotNull(), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p))))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    d = F.col(p) - F.col(y)
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d * d).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")).alias("accuracy"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.covar_pop(p, y) / F.nullif(F.stddev_pop(p) * F.stddev_pop(y), F.lit(0.0))).alias("corr"))
    counted = df.groupBy(*by, p).agg(F.sum(y).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg"))
    below = running(chunked(counted.where(F.col(p).isNotNull()), by, [p]), by, [p], {"_below": ("sum", F.col("_neg"))}, before=True)
    ranked = below.withColumn("_u", F.col("_pos") * (F.coalesce(F.col("_below"), F.lit(0)) + F.col("_neg") / 2))
    auc = ranked.groupBy(*by).agg((F.sum("_u") / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"))
    return plain.join(auc, by)


def vig_audit(quotes: DataFrame, by: list[str], over: str, under: str, actual: str, line: str) -> DataFrame:
    """Margin of a book, and what betting every over or every under returns."""
    blind = lambda side, price: F.avg(O.profit(O.outcome(F.lit(side), actual, line), O.decimal_odds(price)))
    return quotes.groupBy(*by).agg(F.count("*").alias("n"), F.avg(O.vig(over, under)).alias("vig"), blind("over", over).alias("over_roi"), blind("under", under).alias("under_roi"))


def clv(bets: DataFrame, closing: DataFrame, keys: list[str], p_model: Column, price: str) -> DataFrame:
    """Bets with closing-line value: model less closing fair, closing fair less the price paid, and both together."""
    c = closing.select(*keys, F.col("fair").alias("_fair"))
    paid = O.implied_probability(price)
    return bets.join(c, keys).withColumns({"model_clv": p_model - F.col("_fair"), "execution_clv": F.col("_fair") - paid, "total_clv": p_model - paid}).drop("_fair")


def clv_report(valued: DataFrame, by: list[str]) -> DataFrame:
    made = [f(c).alias(n + c) for c in ("model_clv", "execution_clv", "total_clv") for n, f in (("mean_", F.avg), ("positive_", lambda x: F.avg((F.col(x) > 0).cast("int"))))]
    return valued.groupBy(*by).agg(F.count("*").alias("n"), *made)


def bankroll(bets: DataFrame, game: list[str], by: list[str], order: list) -> DataFrame:
    """One bet per game, the first in `order`; wins, losses, pushes, pending, profit and return on what is settled."""
    one = bets.withColumn("_k", F.row_number().over(Window.partitionBy(*by, *game).orderBy(*order))).where("_k = 1")
    tally = lambda r: F.count_if(F.col("result") == r)
    g = one.groupBy(*by).agg(tally("win").alias("wins"), tally("loss").alias("losses"), tally("push").alias("pushes"), F.count_if(F.col("result").isNull()).alias("pending"), F.sum("profit").alias("profit"))
    return g.withColumn("roi", F.col("profit") / F.nullif(F.col("wins") + F.col("losses"), F.lit(0)))


def kernel_audit(df: DataFrame, vector: str, dims: int, prototype: list[float], sigma: float, value: str) -> DataFrame:
    """Kernel-weighted mean of a value around a prototype, its gap to the plain mean, and the effective sample size."""
    d2 = sum(((F.col(vector)[i].cast("double") - float(prototype[i])) ** 2 for i in range(dims)), F.lit(0.0))
    w = F.exp(-d2 / (2 * sigma**2))
    g = df.agg(F.sum(w * F.col(value)).alias("_wx"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.avg(value).alias("_m"))
    return g.select((F.col("_wx") / F.col("_w")).alias("mean"), (F.col("_wx") / F.col("_w") - F.col("_m")).alias("gap"), (F.col("_w") ** 2 / F.col("_w2")).alias("effective_n"))


def lineup_strength(players: DataFrame, team: list[str], slot: str, order: list, metrics: list[str], weights: list[float], min_slots: int, min_stats: int) -> DataFrame:
    """Order-weighted means per lineup with weights of present metrics only, and top less bottom.

    One player per slot, the first in `order`. Lineups need min_slots slots; a metric needs min_stats values.
    """
    one = players.withColumn("_k", F.row_number().over(Window.partitionBy(*team, slot).orderBy(*order))).where("_k = 1")
    w = F.get(F.array(*[F.lit(x) for x in weights]), F.col(slot).cast("int") - 1)
    made = [F.count("*").alias("slots")]
    for m in metrics:
        there = F.count(m) >= min_stats
        made.append(F.when(there, F.sum(F.col(m) * w) / F.sum(F.when(F.col(m).isNotNull(), w))).alias(f"{m}_weighted"))
        made.append(F.when(there, F.avg(F.when(F.col(slot) <= 4, F.col(m))) - F.avg(F.when(F.col(slot) > 4, F.col(m)))).alias(f"{m}_gap"))
    return one.groupBy(*team).agg(*made).where(F.col("slots") >= min_slots)


def park_factor(games: DataFrame, venue: str, value: str) -> DataFrame:
    """Static: a venue's mean over that of all games."""
    league = games.agg(F.avg(value).alias("_league"))
    return games.groupBy(venue).agg(F.count("*").alias("games"), F.avg(value).alias("_m")).join(F.broadcast(league)).select(venue, "games", (F.col("_m") / F.col("_league")).alias("factor"))


def regressed_quality(df: DataFrame, key: str, value: str, full: int) -> DataFrame:
    """Mean pulled to that of all rows: its weight is the number of rows over `full`, at most 1."""
    league = df.agg(F.avg(value).alias("_league"))
    own = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("_m"))
    w = F.least(F.col("n") / full, F.lit(1.0))
    return own.join(F.broadcast(league)).select(key, "n", (w * F.col("_m") + (1 - w) * F.col("_league")).alias("quality"))


def side_mix(bets: DataFrame, by: list[str]) -> DataFrame:
    over = F.col("side") == "over"
    return bets.groupBy(*by).agg(F.count("*").alias("n"), F.avg(over.cast("int")).alias("over_share"), F.avg(F.when(over, F.col("profit"))).alias("over_roi"), F.avg(F.when(~over, F.col("profit"))).alias("under_roi"))


def bias_by(df: DataFrame, by: list[str], pred: str, market: str, actual: str, big: float) -> DataFrame:
    edge = F.abs(F.col(pred) - F.col(market))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(pred) - F.col(actual)).alias("bias"), F.avg(F.col(market) - F.col(actual)).alias("market_bias"), F.avg(edge).alias("edge"), F.avg((edge >= big).cast("int")).alias("big_share"))


def select_then_holdout(bets: DataFrame, is_dev: Column, thresholds: list[float], min_n: int) -> DataFrame:
    """(threshold, dev_roi, n, roi): the threshold with the best return on the dev period, and what it gives after it. Ties go to the smaller."""
    sweep = threshold_sweep(bets.where(is_dev), thresholds).where(F.col("n") >= min_n)
    best = sweep.agg(F.min_by(F.struct("threshold", "roi"), F.struct((-F.round("roi", 9)).alias("a"), "threshold")).alias("_b")).select(F.col("_b.threshold").alias("threshold"), F.col("_b.roi").alias("dev_roi"))
    held = bets.where(~is_dev).join(F.broadcast(best), F.col("ev") >= F.col("threshold"))
    return held.groupBy("threshold", "dev_roi").agg(F.count("*").alias("n"), F.avg("profit").alias("roi"))


def env_offset(games: DataFrame, season: str, order: list[str], actual: str, pred: str, n: int) -> DataFrame:
    """Games after the first n of a season with their prediction moved by the first ones' mean error.

    The first n per season are cut by a window top-k, which Spark limits before the shuffle.
    """
    k = F.row_number().over(Window.partitionBy(season).orderBy(*order))
    first = games.withColumn("_k", k).where(F.col("_k") <= n)
    offset = first.groupBy(season).agg(F.avg(F.col(actual) - F.col(pred)).alias("_o"), F.max(F.struct(*order)).alias("_last"))
    return games.join(offset, season).where(F.struct(*order) > F.col("_last")).withColumn("adjusted", F.col(pred) + F.col("_o")).drop("_o", "_last")


def kelly_path(bets: DataFrame, by: list[str], order: list[str], fraction: str, profit: str) -> DataFrame:
    """Final bankroll and worst relative fall of staking fractions, from running sums of logarithms over ranges of the order."""
    b = chunked(bets.withColumn("_gain", O.bankroll_log_return(fraction, profit)), by, order)
    b = running(b, by, order, {"_log": ("sum", F.col("_gain"))})
    b = running(b, by, order, {"_top": ("max", F.col("_log"))})
    fall = F.exp(F.col("_log") - F.greatest(F.lit(0.0), F.col("_top"))) - 1
    return b.groupBy(*by).agg(F.count("*").alias("n"), F.exp(F.sum("_gain")).alias("final"), F.min(fall).alias("worst_fall"))


def drawdown_of(bets: DataFrame, by: list[str], day: str) -> DataFrame:
    return W.max_drawdown(bets.groupBy(*by, day).agg(F.sum("profit").alias("profit")), by, day, "profit")
