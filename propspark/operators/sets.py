"""Unions, dedupes, boards, latest slices and bet-set overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def team_rows(games: DataFrame, keep: tuple[str, ...] = ("game_id", "day", "season")) -> DataFrame:
    """One row per game and team, made in one scan."""
    side = lambda a, b, home: F.struct(F.col(f"{a}_team").alias("team"), F.col(f"{b}_team").alias("opponent"), F.col(f"{a}_score").alias("score"), F.col(f"{b}_score").alias("allowed"), F.lit(home).alias("is_home"))
    both = F.explode(F.array(side("home", "away", True), side("away", "home", False)))
    return games.select(*[c for c in keep if c in games.columns], both.alias("_t")).select(*[c for c in keep if c in games.columns], "_t.*")


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def bet_overlap(a: DataFrame, b: DataFrame, keys: list[str], won: str) -> DataFrame:
    """(part, n, win_rate) of keys that both, only a and only b hold."""
    parts = [("shared", a.join(b.select(*keys), keys, "left_semi")), ("only_a", a.join(b.select(*keys), keys, "left_anti")), ("only_b", b.join(a.select(*keys), keys, "left_anti"))]
    tagged = concat([df.select(F.lit(name).alias("part"), F.col(won).cast("double").alias("_w")) for name, df in parts])
    return tagged.groupBy("part").agg(F.count("*").alias("n"), F.avg("_w").alias("win_rate"))


def append_scheduled(facts: DataFrame, schedule: DataFrame, flag: str = "is_scheduled") -> DataFrame:
    """Facts with rows of nulls for scheduled games, flagged, so that trailing features reach them."""
    return facts.withColumn(flag, F.lit(False)).unionByName(schedule.withColumn(flag, F.lit(True)), allowMissingColumns=True)


def board(bets: DataFrame, ev: str, volume: str, min_ev: float, min_volume: float, top: int, tie: list[str]) -> DataFrame:
    """The `top` bets by expected value among those with enough value and volume."""
    return bets.where((F.col(ev) >= min_ev) & (F.col(volume) >= min_volume)).orderBy(F.desc(ev), *tie).limit(top)


def latest_snapshot(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the newest capture; the newest time is one row."""
    return df.join(F.broadcast(df.agg(F.max(ts).alias(ts))), ts)


def predictions(df: DataFrame, newest: list, limit: int, **filters) -> DataFrame:
    """Rows that meet every filter that is given (name=value, min_name=value, max_name=value), newest first."""
    for name, value in filters.items():
        if value is None:
            continue
        if name.startswith("min_"):
            df = df.where(F.col(name[4:]) >= value)
        elif name.startswith("max_"):
            df = df.where(F.col(name[4:]) <= value)
        else:
            df = df.where(F.col(name) == value)
    return df.orderBy(*newest).limit(limit)
