"""Trailing windows per entity. Day windows are half-open: the day itself is never seen.

Range frames cost the rows in the frame for every row, so facts are summed to one row per
entity and day first; all columns share one window, hence one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.operators.ordered import numbered, running


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def day_frame(keys, day: str, n: int, last: int = -1):
    return Window.partitionBy(*_keys(keys)).orderBy(F.unix_date(day)).rangeBetween(-n, last)


def daily_counts(df: DataFrame, keys, day: str, made: dict[str, Column]) -> DataFrame:
    """One row per entity and day with every aggregate of `made`, in one pass."""
    return df.groupBy(*_keys(keys), day).agg(*[c.alias(n) for n, c in made.items()])


def rolling_days(df: DataFrame, keys, day: str, columns: list[str], n: int, suffix: str | None = None) -> DataFrame:
    """Sums of `columns` over [day - n, day); null for an empty window. Input: one row per entity and day."""
    w, suffix = day_frame(keys, day, n), suffix or f"_{n}d"
    return df.withColumns({c + suffix: F.sum(c).over(w) for c in columns})


def prefix_days(df: DataFrame, keys, day: str, wanted: dict[int, list[str]]) -> DataFrame:
    """Sums over [day - n, day) as `column_nd` for each n and its columns; 0 for an empty window. Input: one row per entity and day.

    Running sums are taken once; a window is the difference of two of them, the last before the
    day and the last before its start. So a row costs the same for 15 days and 365, and another
    length costs one look-up for all columns together.
    """
    columns = list(dict.fromkeys(c for cs in wanted.values() for c in cs))
    order = Window.partitionBy(*_keys(keys)).orderBy(F.unix_date(day))
    run = [F.sum(F.coalesce(F.col(c), F.lit(0))).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias(c) for c in columns]
    held = df.withColumn("_run", F.struct(*run))
    before = lambda k: F.last("_run").over(order.rangeBetween(Window.unboundedPreceding, -k))
    held = held.withColumns({"_to": before(1), **{f"_from_{n}": before(n + 1) for n in wanted}})
    at = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(0))
    return held.select(*df.columns, *[(at("_to", c) - at(f"_from_{n}", c)).alias(f"{c}_{n}d") for n, cs in wanted.items() for c in cs])


def trailing_distinct(df: DataFrame, keys, day: str, ident: str, n: int, out: str = "n_distinct") -> DataFrame:
    """(keys, day, out): different `ident` in [day - n, day), exact, for every day that the keys have rows on.

    A row of an ident covers the n days behind its own; covers that touch are one. What starts
    and ends on a day is summed per key and day, and the running sum is the count: no ident is
    held in a set, and no row is copied to the days of its window.
    """
    keys = _keys(keys)
    seen = df.where(F.col(day).isNotNull()).select(*keys, day, ident).distinct()
    own = Window.partitionBy(*keys, ident).orderBy(day)
    known = seen.where(F.col(ident).isNotNull()).withColumns({"_a": F.lag(day).over(own), "_z": F.lead(day).over(own)})
    starts = F.when(F.col("_a").isNull() | (F.datediff(day, "_a") >= n), F.struct(F.date_add(day, 1).alias("at"), F.lit(1).alias("d")))
    ends = F.when(F.col("_z").isNull() | (F.datediff("_z", day) >= n), F.struct(F.date_add(day, n + 1).alias("at"), F.lit(-1).alias("d")))
    moves = known.select(*keys, F.explode(F.array_compact(F.array(starts, ends))).alias("_e")).select(*keys, F.col("_e.at").alias(day), F.col("_e.d").alias("_d"), F.lit(False).alias("_row"))
    days = seen.select(*keys, day).distinct().select(*keys, day, F.lit(0).alias("_d"), F.lit(True).alias("_row"))
    daily = moves.unionByName(days).groupBy(*keys, day).agg(F.sum("_d").alias("_d"), F.max("_row").alias("_row"))
    run = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn(out, F.sum("_d").over(run)).where("_row").select(*keys, day, out)


def with_spine(facts: DataFrame, spine: DataFrame, keys, day: str) -> DataFrame:
    """Facts and one row of nulls for each spine day that has none, so that windows reach days without facts."""
    on = [*_keys(keys), day]
    added = spine.select(*on).distinct().join(facts.select(*on).hint("merge"), on, "left_anti")  # merged, as are all tables below that grow: nothing is broadcast from the driver
    return facts.unionByName(added, allowMissingColumns=True)


def with_lookback(read: Callable[[str, str], DataFrame], day: str, start: str, end: str, n: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build() over days from n before the start, trimmed to [start, end) afterwards."""
    from datetime import date, timedelta

    early = (date.fromisoformat(start) - timedelta(days=n)).isoformat()
    return build(read(early, end)).where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date")))


def arsenal(df: DataFrame, keys, day: str, kind: str, kinds: list[str], buckets: dict[str, list[str]], count: str, value: str, n: int, min_count: float) -> DataFrame:
    """Per-kind trailing share and mean as wide columns, buckets of kinds beside them.

    The facts are pivoted to one row per entity and day before the single window. A mean
    needs min_count; below that it takes its bucket's, and null below that. Shares are 0 for
    kinds that were not seen.
    """
    groups = {k: [k] for k in kinds} | buckets
    made = {}
    for name, held in groups.items():
        mine = F.col(kind).isin(held)
        made[f"_n_{name}"] = F.sum(F.when(mine, F.col(count)).otherwise(0))
        made[f"_v_{name}"] = F.sum(F.when(mine, F.col(value)).otherwise(0))
    made["_all"] = F.sum(count)
    wide = daily_counts(df, keys, day, made)
    w = day_frame(keys, day, n)
    summed = wide.select(*_keys(keys), day, *[F.sum(c).over(w).alias(c) for c in made])
    bucket_of = {k: b for b, ks in buckets.items() for k in ks}
    mean = lambda name: F.when(F.col(f"_n_{name}") >= min_count, F.col(f"_v_{name}") / F.col(f"_n_{name}"))
    out = {f"{name}_share": F.when(F.col("_all") > 0, F.col(f"_n_{name}") / F.col("_all")) for name in groups}
    for name in groups:
        out[f"{name}_mean"] = F.coalesce(mean(name), mean(bucket_of[name])) if name in bucket_of else mean(name)
    return summed.select(*_keys(keys), day, *[c.alias(n) for n, c in out.items()])


def rolling_mean(df: DataFrame, keys, day: str, value: str, count: str, n: int, min_count: float = 1) -> Column:
    """Sum of values over sum of counts in [day - n, day)."""
    w = day_frame(keys, day, n)
    total = F.sum(count).over(w)
    return F.when(total >= min_count, F.sum(value).over(w) / total)


def trend(df: DataFrame, keys, day: str, value: str, count: str, short: int, long: int) -> Column:
    """Short trailing mean less the long one; both frames share one sort."""
    return rolling_mean(df, keys, day, value, count, short) - rolling_mean(df, keys, day, value, count, long)


def rolling_weighted(keys, day: str, mean: str, weight: str, n: int) -> Column:
    w = day_frame(keys, day, n)
    total = F.sum(weight).over(w)
    return F.when(total > 0, F.sum(F.col(mean) * F.col(weight)).over(w) / total)


def rolling_rows(keys, order: list[str], column: str, n: int, how: str = "mean", min_n: int = 1, include_current: bool = False) -> Column:
    """mean, sum, std or max of the last n rows; null below min_n values. `order` needs a tie-break."""
    last = 0 if include_current else -1
    w = Window.partitionBy(*_keys(keys)).orderBy(*order).rowsBetween(-n + (1 if include_current else 0), last)
    f = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max}[how]
    return F.when(F.count(column).over(w) >= min_n, f(column).over(w))


def expanding(keys, order: list[str], column: str, how: str = "mean", min_n: int = 1) -> Column:
    """The same over all earlier rows of the keys."""
    w = Window.partitionBy(*_keys(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    f = {"mean": F.avg, "sum": F.sum, "count": F.count}[how]
    return F.when(F.count(column).over(w) >= min_n, f(column).over(w))


def expanding_exact_mean(keys, order: list[str], column: str, min_n: int = 1) -> Column:
    """Mean over all earlier rows of the keys from a sum that does not drift, for values of the size of rates.

    A running sum of doubles loses a bit here and there, and a long one more; where the mean is a
    half of its last place, that decides how it is rounded. Values are added as decimals of 20
    places; where one is not finite, or values or sum reach 1e18, doubles are added.
    """
    w = Window.partitionBy(*_keys(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    exact = F.col(column).try_cast("decimal(38,20)")
    n, total = F.count(column).over(w), F.try_sum(exact).over(w).cast("double")
    mean = F.when(F.count(exact).over(w) == n, total / n)
    return F.when(n >= min_n, F.coalesce(mean, F.avg(column).over(w)))


def season_to_date(keys, season: str, order: list[str], column: str, how: str = "mean") -> Column:
    return expanding([*_keys(keys), season], order, column, how)


def rest_days(keys, day: str, cap: int = 10, default: int | None = None, tie: str | None = None) -> Column:
    """Days since the entity's last event, at most cap; `default` (null) at the first."""
    w = Window.partitionBy(*_keys(keys)).orderBy(*[c for c in (day, tie) if c])
    gap = F.datediff(F.col(day), F.lag(day).over(w))
    return F.when(gap.isNotNull(), F.least(gap, F.lit(cap))).otherwise(F.lit(default).cast("int"))


def games_last(keys, day: str, count: str, n: int = 7) -> Column:
    return F.coalesce(F.sum(count).over(day_frame(keys, day, n)), F.lit(0))


def lag_flag(keys, order: list[str], flag: str) -> Column:
    return F.lag(flag).over(Window.partitionBy(*_keys(keys)).orderBy(*order))


def h2h_residual(keys, opponent: str, order: list[str], stat: str, form: str, k: float) -> Column:
    """Shrunk mean of stat - form over earlier meetings: their sum over (n + k); null before the first."""
    w = Window.partitionBy(*_keys(keys), opponent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.col(stat) - F.col(form)).over(w)
    return F.when(n > 0, F.sum(F.col(stat) - F.col(form)).over(w) / (n + k))


def park_factor_rolling(games: DataFrame, venue: str, day: str, value: str, n: int = 365, min_games: int = 30) -> DataFrame:
    """(venue, day, games, factor): the venue's trailing mean over the league's; the league window runs over one row per day."""
    daily = games.groupBy(venue, day).agg(F.count("*").alias("_g"), F.sum(value).alias("_v"))
    w = day_frame(venue, day, n)
    own = daily.select(venue, day, F.sum("_g").over(w).alias("games"), F.sum("_v").over(w).alias("_vs"))
    league = games.groupBy(day).agg(F.count("*").alias("_g"), F.sum(value).alias("_v"))
    every = Window.orderBy(F.unix_date(day)).rangeBetween(-n, -1)
    league = league.select(day, (F.sum("_v").over(every) / F.sum("_g").over(every)).alias("_rate"))
    joined = own.join(league, day)
    return joined.select(venue, day, "games", F.when(F.col("games") >= min_games, F.col("_vs") / F.col("games") / F.col("_rate")).alias("factor"))


def rate_less_league(df: DataFrame, keys, day: str, num: str, den: str, n: int, min_den: float) -> DataFrame:
    """Trailing rate of an entity less the league's trailing rate of the same days."""
    w = day_frame(keys, day, n)
    own = df.select(*_keys(keys), day, F.sum(num).over(w).alias("_num"), F.sum(den).over(w).alias("_den"))
    every = Window.orderBy(F.unix_date(day)).rangeBetween(-n, -1)
    league = df.groupBy(day).agg(F.sum(num).alias("_a"), F.sum(den).alias("_b")).select(day, (F.sum("_a").over(every) / F.sum("_b").over(every)).alias("_rate"))
    return own.join(league, day).select(*_keys(keys), day, F.when(F.col("_den") >= min_den, F.col("_num") / F.col("_den") - F.col("_rate")).alias("rate_gap"))


def mean_beside(keys, slot: str, column: str, ahead: bool) -> Column:
    """Mean of the group's rows with a smaller (ahead) or larger slot; equal slots are left out."""
    w = Window.partitionBy(*_keys(keys)).orderBy(slot)
    w = w.rangeBetween(Window.unboundedPreceding, -1) if ahead else w.rangeBetween(1, Window.unboundedFollowing)
    return F.avg(column).over(w)


def argmax_by(df: DataFrame, keys, value: str, n: str) -> DataFrame:
    """The value with the largest sum of n per keys, the smallest value on a tie."""
    counted = df.groupBy(*_keys(keys), value).agg(F.sum(n).alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b")))
    return counted.groupBy(*_keys(keys)).agg(best.alias(value), F.max("_n").alias("n"))


def trailing_ranks(df: DataFrame, team: str, entity: str, day: str, value: str, n: int, k: int, spine: DataFrame | None = None) -> DataFrame:
    """(team, day, entity, total, place): a team's k entities with most value in [day - n, day), for its own days or those of the spine.

    Each fact is offered to the team's days in (day, day + n]; only those days are made, and
    the facts are summed per entity before they are ranked.
    """
    days = (df if spine is None else spine).select(team, day).distinct()
    facts = df.groupBy(team, entity, day).agg(F.sum(value).alias("_v")).withColumnRenamed(day, "_at")
    near = facts.withColumn("_b", F.explode(F.array(F.floor(F.unix_date("_at") / n), F.floor(F.unix_date("_at") / n) + 1)))
    slots = days.withColumn("_b", F.floor(F.unix_date(day) / n))
    met = slots.join(near.hint("merge"), [team, "_b"]).where((F.datediff(F.col(day), F.col("_at")) >= 1) & (F.datediff(F.col(day), F.col("_at")) <= n))
    totals = met.groupBy(team, day, entity).agg(F.sum("_v").alias("total"))
    order = Window.partitionBy(team, day).orderBy(F.desc("total"), entity)
    return totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def absent_topk(df: DataFrame, team: str, entity: str, day: str, value: str, n: int, k: int) -> DataFrame:
    """(team, day, absent): how many of a team's k regulars have no row that day."""
    top = trailing_ranks(df, team, entity, day, value, n, k)
    here = df.select(team, day, entity).distinct().withColumn("_here", F.lit(1))
    return top.join(here.hint("merge"), [team, day, entity], "left").groupBy(team, day).agg(F.count_if(F.col("_here").isNull()).alias("absent"))


def topk_available(df: DataFrame, team: str, entity: str, day: str, value: str, n: int, k: int, rest: int, spine: DataFrame | None = None) -> DataFrame:
    """(team, day, available): share of a team's k most used entities without a row in the last `rest` days."""
    top = trailing_ranks(df, team, entity, day, value, n, k, spine)
    used = df.select(team, entity, day).distinct().withColumn(day, F.explode(F.array(*[F.date_add(day, i) for i in range(1, rest + 1)]))).distinct().withColumn("_used", F.lit(1))
    return top.join(used.hint("merge"), [team, entity, day], "left").groupBy(team, day).agg(F.avg(F.col("_used").isNull().cast("double")).alias("available"))


def lineup_profile(df: DataFrame, team: str, entity: str, day: str, value: str, attribute: DataFrame, column: str, n: int, k: int, top: int) -> DataFrame:
    """(team, day, mean_k, mean_top): mean attribute of a team's usual k entities, and of the `top` largest among them."""
    usual = trailing_ranks(df, team, entity, day, value, n, k).join(attribute, entity)
    held = usual.groupBy(team, day).agg(F.avg(column).alias("mean_k"), F.sort_array(F.collect_list(column), asc=False).alias("_all"))  # k values at most
    best = F.slice("_all", 1, top)
    return held.select(team, day, "mean_k", (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)).alias("mean_top"))


def ffill(keys, order: list[str], column: str, default) -> Column:
    w = Window.partitionBy(*_keys(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(column, ignorenulls=True).over(w), F.lit(default))


def streak(df: DataFrame, keys, order: list[str], flag: str, out: str = "streak") -> DataFrame:
    """Length so far of the run of true flags that a row ends; 0 where the flag is not true."""
    w = Window.partitionBy(*_keys(keys)).orderBy(*order)
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    island = df.withColumn("_island", F.sum(F.when(on, 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*_keys(keys), "_island")
    return island.withColumn(out, F.sum(on.cast("long")).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def days_to_gap(schedule: DataFrame, keys, day: str, cap: int = 7) -> DataFrame:
    """(keys, day, days_to_gap): days until the run of consecutive days ends, at most cap. Input days may repeat."""
    days = schedule.select(*_keys(keys), day).distinct()
    w = Window.partitionBy(*_keys(keys)).orderBy(day)
    island = days.withColumn("_i", F.unix_date(day) - F.row_number().over(w))
    end = F.max(day).over(Window.partitionBy(*_keys(keys), "_i"))
    return island.select(*_keys(keys), day, F.least(F.datediff(end, F.col(day)) + 1, F.lit(cap)).alias("days_to_gap"))


def max_drawdown(daily: DataFrame, by: list[str], day: str, profit: str) -> DataFrame:
    """(by, total, drawdown): the deepest fall of the running sum below its running peak (from 0 on). Input: one row per by and day."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumn("_c", F.sum(profit).over(w))
    run = run.withColumn("_p", F.greatest(F.lit(0.0), F.max("_c").over(w)))
    return run.groupBy(*by).agg(F.sum(profit).alias("total"), F.min(F.col("_c") - F.col("_p")).alias("drawdown"))


def latest_per(df: DataFrame, keys, ts: str, tie: str) -> DataFrame:
    """The newest row of each key, the larger tie-break of two of one time."""
    rest = [c for c in df.columns if c not in _keys(keys)]
    newest = F.max_by(F.struct(*rest), F.struct(ts, tie))
    return df.groupBy(*_keys(keys)).agg(newest.alias("_r")).select(*_keys(keys), "_r.*")


def open_close(df: DataFrame, keys, ts: str, tie: str, price: str) -> DataFrame:
    at = F.struct(ts, tie)
    return df.groupBy(*_keys(keys)).agg(F.min_by(price, at).alias("opening"), F.max_by(price, at).alias("closing"), F.count("*").alias("n"))


def streak_stats(bets: DataFrame, by: list[str], order: list[str], result: str, profit: str, bankroll: float) -> DataFrame:
    """Longest runs of wins and losses per group, and the deepest relative fall of the bankroll.

    A run's length is a row's place less that of the last row that broke it; places, breaks,
    sums and peaks run over ranges of the order, so that a long group is spread over tasks.
    `order` must tell a group's rows apart.
    """
    w = numbered(bets, by, order, "_no")
    broke = lambda name: F.when(~F.coalesce(F.col(result) == name, F.lit(False)), F.col("_no"))
    w = running(w, by, order, {"_win": ("last", broke("win")), "_loss": ("last", broke("loss")), "_sum": ("sum", F.col(profit))})
    w = w.withColumn("_b", F.lit(float(bankroll)) + F.coalesce("_sum", F.lit(0.0)))
    w = running(w, by, order, {"_top": ("max", F.col("_b"))}).withColumn("_peak", F.greatest(F.lit(float(bankroll)), F.col("_top")))
    run = lambda c: F.max(F.col("_no") - F.coalesce(F.col(c), F.lit(0)))
    return w.groupBy(*by).agg(run("_win").alias("longest_win"), run("_loss").alias("longest_loss"), F.min(F.col("_b") / F.col("_peak") - 1).alias("worst_fall"))
