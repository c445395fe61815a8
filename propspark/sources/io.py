"""Table reads, caches, flattening of nested payloads, idempotent writes, upserts and health."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str, start: str | None = None, end: str | None = None, day: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, cut to [start, end) of its day column; filter and columns reach the scan."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    if day and start:
        df = df.where(F.col(day) >= F.lit(start).cast(df.schema[day].dataType))
    if day and end:
        df = df.where(F.col(day) < F.lit(end).cast(df.schema[day].dataType))
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table in `parts` ranges of a numeric column, one task each."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options)
    return reader.load()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
    """The table at `path`; it is built and written there first if it is not complete."""
    if not _exists(spark, path):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True, dateFormat=date_format, enforceSchema=False)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


PROP = "id LONG, player STRUCT<first: STRING, last: STRING, team: STRING>, over STRUCT<line: DOUBLE, odds: INT>, under STRUCT<line: DOUBLE, odds: INT>, score STRUCT<actual: DOUBLE>"


def flatten_prop(df: DataFrame, column: str) -> DataFrame:
    """Nested quote records as flat rows; what an absent object would hold is null."""
    r = F.from_json(column, PROP)
    picked = {"prop_id": "id", "player_first": "player.first", "player_last": "player.last", "team": "player.team", "over_line": "over.line", "over_odds": "over.odds", "under_odds": "under.odds", "actual": "score.actual"}
    return df.withColumn("_r", r).select(*[c for c in df.columns if c != column], *[F.col(f"_r.{p}").alias(n) for n, p in picked.items()])


LINES = "players ARRAY<STRUCT<id: STRING, name: STRING>>, appearances ARRAY<STRUCT<id: STRING, player_id: STRING>>, lines ARRAY<STRUCT<id: STRING, appearance_id: STRING, stat: STRING, value: DOUBLE, options: ARRAY<STRUCT<choice: STRING, price: INT>>>>"


def flatten_lines(payloads: DataFrame, payload_id: str, column: str) -> DataFrame:
    """Payloads of three lists, joined by their ids, one row per line and option; lines without options keep one row."""
    p = payloads.select(payload_id, F.from_json(column, LINES).alias("_p"))
    players = p.select(payload_id, F.explode("_p.players").alias("x")).select(payload_id, F.col("x.id").alias("player_id"), F.col("x.name").alias("player"))
    appearances = p.select(payload_id, F.explode("_p.appearances").alias("x")).select(payload_id, F.col("x.id").alias("appearance_id"), F.col("x.player_id").alias("player_id"))
    lines = p.select(payload_id, F.explode("_p.lines").alias("x")).select(payload_id, F.col("x.id").alias("line_id"), F.col("x.appearance_id").alias("appearance_id"), F.col("x.stat").alias("stat"), F.col("x.value").alias("value"), F.explode_outer("x.options").alias("o"))
    joined = lines.join(appearances, [payload_id, "appearance_id"], "left").join(players, [payload_id, "player_id"], "left")
    return joined.select(payload_id, "line_id", "player", "stat", "value", F.col("o.choice").alias("choice"), F.col("o.price").alias("price"))


def pick_side(options: Column | str, field: str, wanted: str) -> Column:
    """First element of an array of structs whose field has the wanted value, else null."""
    return F.get(F.filter(options, lambda x: x[field] == wanted), 0)


ODDS_MAP = "MAP<STRING, ARRAY<STRUCT<home: STRING, away: STRING, moneyline: STRUCT<home: INT, away: INT>, spread: STRUCT<line: DOUBLE, home: INT, away: INT>, total: STRUCT<line: DOUBLE, over: INT, under: INT>>>>"


def load_odds_map(df: DataFrame, column: str) -> DataFrame:
    """Objects keyed by date that hold lists of games, as one row per date, game and market."""
    games = df.select(F.explode(F.from_json(column, ODDS_MAP)).alias("date", "games")).select("date", F.explode("games").alias("g"))
    row = lambda market, line, a, b: F.struct(F.lit(market).alias("market"), line.cast("double").alias("line"), a.alias("first_odds"), b.alias("second_odds"))
    none = F.lit(None)
    markets = F.array(
        row("moneyline", none, F.col("g.moneyline.home"), F.col("g.moneyline.away")),
        row("spread", F.col("g.spread.line"), F.col("g.spread.home"), F.col("g.spread.away")),
        row("total", F.col("g.total.line"), F.col("g.total.over"), F.col("g.total.under")),
    )
    long = games.select(F.to_date("date").alias("day"), "g.home", "g.away", F.explode(markets).alias("m"))
    return long.select("day", "home", "away", "m.*").where("first_odds IS NOT NULL OR second_odds IS NOT NULL")


def extract_embedded_json(df: DataFrame, column: str, pattern: str, schema: str, out: str = "blob") -> DataFrame:
    """The first group of `pattern` in a page, parsed; null where it is missing or malformed."""
    return df.withColumn(out, F.from_json(F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")), schema))


def new_only(source: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return source.join(existing.select(*keys), keys, "left_anti")


def append_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of `batch` to insert: one per key, the first in `order`, of keys that `target` lacks."""
    from propspark.operators.sets import dedupe

    return new_only(dedupe(batch, keys, order), target, keys)


def append_to(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list) -> None:
    """Insert into the table at `path`, ignoring keys that it has; running twice changes nothing."""
    append_new(spark.read.parquet(path), batch, keys, order).write.mode("append").parquet(path)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str], closing: dict[str, str] | None = None) -> DataFrame:
    """`target` with the batch merged in: new keys are added; of known ones only `update` columns change, and not to null.

    closing maps a first-seen column to the closing column that takes the batch's value of it;
    the first-seen value stays. One batch row per key.
    """
    closing = closing or {}
    t, b = target.alias("t"), batch.alias("b")
    known = F.col(f"t.{keys[0]}").isNotNull()
    out = []
    back = {v: k for k, v in closing.items()}
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"b.{c}") if c in batch.columns else F.lit(None)
        if c in keys:
            value = F.coalesce(old, new)
        elif c in back:
            value = F.coalesce(F.col(f"b.{back[c]}"), old)
        elif c in update:
            value = F.coalesce(new, old)
        else:
            value = F.when(known, old).otherwise(new)
        out.append(value.alias(c))
    on = [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys]
    return t.join(b, on, "full").select(*out)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that `df` holds. The rows are written aside first, as they may come from `path` itself."""
    spark = df.sparkSession
    aside = f"{path}.next-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """`df` as the table `name` with its files under `path`, hashed into buckets by the keys and sorted within them.

    Tables with the same keys and number of buckets join, and are grouped by the keys, where
    they lie. Rows of a bucket are dealt to its one file first, so there are as many files as
    buckets. A table of that name is replaced.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    placed = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").format("parquet").saveAsTable(f"`{name}`")
    return spark.table(f"`{name}`")


def changed_rows(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of `new` whose columns differ from the stored ones, nulls compared as values."""
    n, o = new.alias("n"), old.alias("o")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}")).where(~same).select("n.*")


def health(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, n, latest) of each table and its day column."""
    from propspark.operators.sets import concat

    return concat([df.agg(F.count("*").alias("n"), F.max(F.to_date(day)).alias("latest")).select(F.lit(name).alias("table_name"), "n", "latest") for name, (df, day) in tables.items()])


def coverage_by(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, mean, p10, p90): share of non-nulls, mean and exact deciles of each column."""
    from propspark.operators.ordered import order_statistics

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_s")).select("_s.*")
    cuts = order_statistics(long, ["column_name"], "v", [0.1, 0.9])
    rows = [(c, *cuts.get((c,), [None, None])) for c in columns]
    deciles = df.sparkSession.createDataFrame(rows, "column_name string, p10 double, p90 double")
    filled = long.groupBy("column_name").agg((F.count("v") / F.count("*")).alias("filled"), F.avg("v").alias("mean"))
    return filled.join(F.broadcast(deciles), "column_name").select("column_name", "filled", "mean", "p10", "p90")
