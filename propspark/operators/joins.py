"""Joins: as-of, nearest, prior days, date-tolerant, opponents, dimensions, sources.

As-of joins are a union and one window, so a key's rows are read once and never multiplied.
A dimension is left to Catalyst, which broadcasts it while its size permits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.operators.ordered import order_statistics


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def enrich(fact: DataFrame, dims: list[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """`fact` with each (dimension, fact key, dimension key); the dimension's key goes."""
    for dim, left, right in dims:
        fact = fact.join(dim, F.col(left) == dim[right], how).drop(dim[right])
    return fact


def join_companion(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of two large facts on the same keys; without a shuffle where both come from `io.save_bucketed` with these keys."""
    return a.join(b, keys, how)


def attach_opponent(df: DataFrame, other: DataFrame, game: str, team: str, columns: list[str], prefix: str = "opp_") -> DataFrame:
    """Left join with the row of the same game and the other team."""
    right = other.select(F.col(game).alias("_g"), F.col(team).alias("_t"), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(right, (F.col(game) == F.col("_g")) & (F.col(team) != F.col("_t")), "left").drop("_g", "_t")


def asof(left: DataFrame, right: DataFrame, by, on: str, columns: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """Every left row with `columns` of its key's last right row at or before (strict: before) it.

    Of right rows at one time the one with the larger tie-break counts. Left rows with a null
    key keep nulls and stay out of the window.
    """
    by = _keys(by)
    held = F.struct(*columns)
    null_key = F.lit(False)
    for k in by:
        null_key = null_key | F.col(k).isNull()
    lone = left.where(null_key).withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in columns})
    keep = [c for c in left.columns if c not in by and c != on]
    a = left.where(~null_key).select(*by, on, F.struct(*[F.col(c) for c in keep] or [F.lit(1).alias("_")]).alias("_left"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("_right"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"))
    b = right.where(~null_key).where(F.col(on).isNotNull()).select(*by, on, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), held.alias("_right"), F.lit(1 if strict else 0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    w = Window.partitionBy(*by).orderBy(F.col(on), "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    out = met.select(*by, on, *[F.col(f"_left.{c}").alias(c) for c in keep], *[F.col(f"_last.{c}").alias(c) for c in columns])
    return out.select(*left.columns, *columns).unionByName(lone)


def nearest(left: DataFrame, right: DataFrame, by, ts: str, seconds: int, left_id: str, columns: list[str], tie: str) -> DataFrame:
    """Every left row that has a right row of its key within `seconds`, with the nearest one's columns and the gap.

    Both sides are sorted together, once in each direction: a left row takes the last right row
    before it and the first behind it, and of these the nearer one, on a tie the one with the
    smaller `tie`. No pairs are made. Times fall in buckets of `seconds`, and a right row is
    offered to its own and both neighbouring ones, so a key is spread over its buckets. Rows
    without a key or a time have no neighbour. left_id is not needed to tell rows apart.
    """
    by = _keys(by)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    keyed = lambda df: df.where(F.col(ts).isNotNull() & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in by)))
    bucket = F.floor(F.col("_t") / width)
    held = F.struct(F.col("_t").alias("t"), F.col(tie).alias("tie"), *[F.col(c).alias(f"c_{c}") for c in columns])
    a = keyed(left).withColumn("_t", at(ts)).select(*[F.col(k).alias(f"_k_{k}") for k in by], "_t", bucket.alias("_b"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    b = keyed(right).withColumn("_t", at(ts)).select(*[F.col(k).alias(f"_k_{k}") for k in by], "_t", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"), held.alias("_right"), F.col(tie).alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    group = Window.partitionBy(*[f"_k_{k}" for k in by], "_b")
    is_left = F.col("_left").isNotNull()
    # of one time, the right row with the smallest tie comes last before the left rows, in either direction
    up = group.orderBy(F.col("_t"), is_left, F.desc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    down = group.orderBy(F.desc("_t"), is_left, F.desc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_before", F.last("_right", ignorenulls=True).over(up)).withColumn("_behind", F.last("_right", ignorenulls=True).over(down)).where(is_left)
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("_t")).alias("gap"), F.col(f"{c}.tie").alias("tie"), F.col(c).alias("row")))
    best = F.array_min(F.array_compact(F.array(near("_before"), near("_behind"))))
    found = met.withColumn("_best", best).where(F.col("_best.gap") <= width)
    return found.select("_left.*", *[F.col(f"_best.row.c_{c}").alias(f"near_{c}") for c in columns], (F.col("_best.gap") / 1_000_000).alias("gap_seconds"))


def overlap(quotes: DataFrame, soft: int, sharp: int, keys: list[str], book: str, columns: list[str]) -> DataFrame:
    """Quotes that two books share; each side is cut to its book before the join."""
    side = lambda b, name: quotes.where(F.col(book) == b).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return side(soft, "soft").join(side(sharp, "sharp"), keys)


def prior_days(spine: DataFrame, daily: DataFrame, keys, day: str, value: str, back: list[int]) -> DataFrame:
    """`spine` with the value of the day k days earlier for each k; 0 where there was none."""
    keys = _keys(keys)
    shifted = daily.select(*keys, F.explode(F.array(*[F.struct(F.date_add(day, k).alias("at"), F.lit(k).alias("k")) for k in back])).alias("_s"), value)
    wide = shifted.groupBy(*keys, F.col("_s.at").alias(day)).agg(*[F.sum(F.when(F.col("_s.k") == k, F.col(value))).alias(f"{value}_{k}") for k in back])
    return spine.join(wide, [*keys, day], "left").fillna(0, [f"{value}_{k}" for k in back])


def semi(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right, _keys(keys), "left_semi")


def anti(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right, _keys(keys), "left_anti")


def outer_merge(frames: list[DataFrame], keys, zero: list[str]) -> DataFrame:
    """Full outer join of aggregates; only the `zero` columns get 0 for nulls."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, _keys(keys), "full")
    return out.fillna(0, zero)


def paired_decomposition(a: DataFrame, b: DataFrame, keys, side: str, profit: str) -> DataFrame:
    """(part, n, mean_a, mean_b): bets both took alike, took on other sides, or only one took."""
    keys = _keys(keys)
    x = a.select(*keys, F.col(side).alias("_sa"), F.col(profit).alias("_pa"))
    y = b.select(*keys, F.col(side).alias("_sb"), F.col(profit).alias("_pb"))
    part = F.when(F.col("_sb").isNull(), "only_a").when(F.col("_sa").isNull(), "only_b").when(F.col("_sa") == F.col("_sb"), "common").otherwise("flipped")
    return x.join(y, keys, "full").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg("_pa").alias("mean_a"), F.avg("_pb").alias("mean_b"))


def with_opponent(df: DataFrame, game: str, team: str, columns: list[str]) -> DataFrame:
    """Each team row with the other team's columns, from one window over its game (two rows each)."""
    w = Window.partitionBy(game)
    out = df
    for c in columns:
        pairs = F.collect_list(F.struct(F.col(team).alias("t"), F.col(c).alias("v"))).over(w)
        out = out.withColumn(f"opp_{c}", F.get(F.filter(pairs, lambda x: x["t"] != F.col(team)), 0)["v"])
    return out


def prior_season(df: DataFrame, agg: DataFrame, keys, season: str) -> DataFrame:
    """Left join with the aggregate of the season before."""
    shifted = agg.withColumn(season, F.col(season) + 1)
    return df.join(shifted, [*_keys(keys), season], "left")


def home_away_view(games: DataFrame, teams: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Games with the columns of both teams' dimension rows."""
    for side in ("home", "away"):
        dim = teams.select(F.col(key).alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        games = games.join(dim, F.col(f"{side}_team") == F.col(f"_{side}"), "left").drop(f"_{side}")
    return games


def actual_or_probable(actual: Column, probable: Column) -> Column:
    return F.coalesce(actual, probable)


def agreement_split(bets: DataFrame, signals: DataFrame, keys, side: str, profit: str) -> DataFrame:
    """(agrees, n, roi) of bets by whether the signal of the same key takes the same side."""
    s = signals.select(*_keys(keys), F.col(side).alias("_signal"))
    return bets.join(s, _keys(keys)).groupBy((F.col(side) == F.col("_signal")).alias("agrees")).agg(F.count("*").alias("n"), F.avg(profit).alias("roi"))


def compare_sources(a: DataFrame, b: DataFrame, keys, value: str) -> DataFrame:
    """(n, mean_diff, median_diff, max_diff) of absolute differences of one value in two sources."""
    met = a.select(*_keys(keys), F.col(value).alias("_a")).join(b.select(*_keys(keys), F.col(value).alias("_b")), _keys(keys))
    met = met.select(F.abs(F.col("_a") - F.col("_b")).alias("_d"))
    (median,) = order_statistics(met, [], "_d", [0.5]).get((), [None])
    return met.agg(F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.lit(median).cast("double").alias("median_diff"), F.max("_d").alias("max_diff"))


def dual_date_join(left: DataFrame, right: DataFrame, keys, day: str, left_id: str, columns: list[str], tie: str, shifts: tuple[int, ...] = (0, -1, 1), how: str = "inner") -> DataFrame:
    """Left rows with columns of a right row of the same day or a day beside it, the exact day first; how="left" keeps those that have none."""
    keys = _keys(keys)
    moved = right.select(*keys, F.col(tie).alias("_tie"), F.explode(F.array(*[F.struct(F.date_add(day, s).alias("at"), F.lit(i).alias("rank")) for i, s in enumerate(shifts)])).alias("_s"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    met = left.join(moved.withColumn(day, F.col("_s.at")), [*keys, day], how)
    order = Window.partitionBy(left_id).orderBy("_s.rank", "_tie")
    return met.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*left.columns, F.col("_s.rank").alias("shift_rank"), *[F.col(f"_r_{c}").alias(c) for c in columns])


def travel(games: DataFrame, zones: DataFrame, team: str = "team", tz: str = "tz") -> DataFrame:
    """Visitor's zone less the host's in hours, local hour of the host, night games, and trips to the east."""
    out = home_away_view(games, zones, team, [tz])
    lag = F.col(f"away_{tz}") - F.col(f"home_{tz}")
    local = F.pmod(F.col("utc_hour") + F.col(f"home_{tz}"), F.lit(24)).cast("int")
    return out.withColumns({"lag_hours": lag.cast("int"), "local_hour": local, "is_night": local >= 17, "eastward": lag < 0})
