"""Streams over the events table, run to their end; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.queries.registry import query
from propspark.queries.sources import work_dir
from propspark.streaming import snapshots as X
from propspark.streaming import state as S
from propspark.views import table, view, with_views

SNAP_COLUMNS = {
    "quote_id": "event_id",
    "captured_at": "CAST(ts AS TIMESTAMP)",
    "scheduled_start": "CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 18 HOURS",
    "prop_id": "user_id % 20",
    "source": "event_type",
    "over_odds": "CAST(-(105 + CAST(floor(value) AS INT) % 20) AS INT)",
}


def events_path(sf):
    """A pattern, as a file stream takes folders and patterns only and the table may be one file."""
    return f"{sf}/events.parque[t]"


def snap_stream(spark, sf):
    """The snapshot view as a stream without repeated quotes."""
    schema = table(spark, sf, "events").schema
    made = {n: F.expr(e) for n, e in SNAP_COLUMNS.items()}
    s = X.stream_snapshots(spark, events_path(sf), schema, ["quote_id"], "captured_at", "2 hours", made)
    return s.select(*SNAP_COLUMNS)


@query("x01_ingest", with_views("SELECT quote_id, prop_id, source, over_odds FROM snap", "snap"))
def x01(spark, sf):
    out = work_dir(spark, "ingest")
    X.run_available(snap_stream(spark, sf), f"{out}-state", out)
    return spark.read.parquet(out).select("quote_id", "prop_id", "source", "over_odds")


@query("x02_pre_game", with_views("SELECT quote_id FROM snap WHERE scheduled_start > captured_at", "snap"))
def x02(spark, sf):
    out = work_dir(spark, "pregame")
    X.run_available(X.pre_game(snap_stream(spark, sf)), f"{out}-state", out)
    return spark.read.parquet(out).select("quote_id")


@query(
    "x03_pair_streams",
    with_views(
        """, m AS (SELECT a.quote_id AS sharp_quote_id, b.quote_id AS soft_quote_id, row_number() OVER (PARTITION BY a.quote_id ORDER BY abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)), b.quote_id) AS k
           FROM snap a JOIN snap b ON a.prop_id = b.prop_id AND a.source = 'view' AND b.source = 'click' AND b.captured_at BETWEEN a.captured_at - INTERVAL 20 MINUTES AND a.captured_at + INTERVAL 20 MINUTES)
        SELECT sharp_quote_id, soft_quote_id FROM m WHERE k = 1""",
        "snap",
    ),
)
def x03(spark, sf):
    out = work_dir(spark, "pairs")
    made = {n: F.expr(e) for n, e in SNAP_COLUMNS.items()}
    clock = spark.createDataFrame([("2100-01-01",)], "at string").selectExpr("CAST(at AS timestamp) AS captured_at")
    clock.limit(0).write.parquet(f"{out}-clock")
    S.use_rocksdb(spark)

    def paired():
        raw = spark.readStream.schema(table(spark, sf, "events").schema).parquet(events_path(sf)).withColumns(made)
        side = lambda s: raw.where(F.col("source") == s).select("prop_id", "quote_id", "captured_at")
        ended = spark.readStream.schema(clock.schema).parquet(f"{out}-clock")
        return S.nearest_stream(side("view"), side("click"), ["prop_id"], "captured_at", "quote_id", 20, "1 hour", ended)

    X.run_available(paired(), f"{out}-state", out)
    clock.write.mode("append").parquet(f"{out}-clock")
    X.run_available(paired(), f"{out}-state", out)
    return spark.read.parquet(out).select(F.col("sharp_id").alias("sharp_quote_id"), F.col("soft_id").alias("soft_quote_id"))


@query("x04_quote_windows", with_views("SELECT time_bucket(INTERVAL 1 HOUR, captured_at) AS window_start, source, count(*) AS n, min(over_odds) AS low, max(over_odds) AS high, max(over_odds) - min(over_odds) AS move FROM snap GROUP BY 1, 2", "snap"))
def x04(spark, sf):
    out = work_dir(spark, "windows")
    agg = X.quote_windows(snap_stream(spark, sf), "captured_at", ["source"], "over_odds", "1 hour")
    X.run_available(agg, f"{out}-state", each=lambda b, i: b.write.mode("overwrite").parquet(out) if not b.isEmpty() or i == 0 else None, mode="complete")
    return spark.read.parquet(out)


@query(
    "x05_edge_sessions",
    with_views(
        """, f AS (SELECT prop_id, captured_at FROM snap WHERE over_odds >= -108), g AS (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS brk FROM f WINDOW w AS (PARTITION BY prop_id ORDER BY captured_at)), s AS (SELECT *, sum(brk) OVER (PARTITION BY prop_id ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS i FROM g)
        SELECT prop_id, count(*) AS captures, min(captured_at) AS first_seen, max(captured_at) AS last_seen FROM s GROUP BY prop_id, i""",
        "snap",
    ),
)
def x05(spark, sf):
    flagged = view(spark, sf, "snap").where("over_odds >= -108")
    return X.edge_sessions(flagged, "captured_at", ["prop_id"], "6 hours")


@query("x06_latest_state", with_views("SELECT prop_id, source, arg_min(over_odds, quote_id) AS opening, arg_max(over_odds, quote_id) AS closing FROM snap GROUP BY 1, 2", "snap"))
def x06(spark, sf):
    out = work_dir(spark, "state")
    S.use_rocksdb(spark)
    prices = S.latest_prices(snap_stream(spark, sf), ["prop_id", "source"], "captured_at", "quote_id", "over_odds")
    X.run_available(prices, f"{out}-checkpoint", each=S.write_changes(out), mode="update", idle_batches=False)
    return S.current(spark.read.parquet(out), ["prop_id", "source"]).select("prop_id", "source", "opening", "closing")


SETTLE = """, t AS (SELECT player_id, book_id, line, CASE WHEN over_odds > under_odds THEN 'over' ELSE 'under' END AS side FROM quotes), x AS (SELECT l_partkey AS player_id, CAST(count(*) % 6 AS DOUBLE) AS actual FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1)
        SELECT t.player_id, book_id, line, side, actual, CASE WHEN actual = line THEN 'push' WHEN (side = 'over') = (actual > line) THEN 'win' WHEN actual IS NOT NULL THEN 'loss' END AS result, CAST(CASE WHEN actual IS NULL THEN NULL WHEN actual = line THEN 0.0 WHEN (side = 'over') = (actual > line) THEN 0.9 ELSE -1.0 END AS DOUBLE) AS profit FROM t LEFT JOIN x USING (player_id)"""


@query("x07_settle", with_views(SETTLE, "quotes"))
def x07(spark, sf):
    """Bets and box rows come as streams, in four batches; every key closes at one time, which the clock says at the end."""
    out = work_dir(spark, "settle")
    at = F.lit("1999-01-01 12:00:00").cast("timestamp")
    q = view(spark, sf, "quotes")
    side = F.when(F.col("over_odds") > F.col("under_odds"), "over").otherwise("under")
    bets = q.select("player_id", "book_id", "line", side.alias("side"), F.lit(1.9).alias("payout"), F.concat_ws("/", "player_id", "book_id", F.monotonically_increasing_id()).alias("bet_id"), at.alias("at"))
    box = table(spark, sf, "lineitem").where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("player_id"), (F.col("l_orderkey") % 4).alias("part")).agg(F.count("*").alias("hits"))
    box = box.select("player_id", "hits", F.concat_ws("/", "player_id", "part").alias("row_id"), at.alias("at"), "part")
    bets.write.parquet(f"{out}/bets")
    box.repartition(4, "part").write.parquet(f"{out}/box")
    clock = spark.createDataFrame([("1999-01-03",)], "at string").selectExpr("CAST(at AS timestamp) AS at")
    clock.limit(0).write.parquet(f"{out}/clock")
    S.use_rocksdb(spark)

    def settled():
        stream = lambda name, df, **o: spark.readStream.schema(df.schema).options(**o).parquet(f"{out}/{name}")
        return S.settle_stream(stream("bets", bets), stream("box", box, maxFilesPerTrigger=1), ["player_id"], ["hits"], "line", "side", "payout", ("bet_id", "row_id"), "at", F.lit("1999-01-02"), "1 hour", stream("clock", clock), lambda total: total % 6)

    X.run_available(settled(), f"{out}/state", f"{out}/settled")
    clock.write.mode("append").parquet(f"{out}/clock")
    X.run_available(settled(), f"{out}/state", f"{out}/settled")
    found = spark.read.parquet(f"{out}/settled")
    return found.select("player_id", "book_id", "line", "side", "actual", "result", F.round("profit", 6).alias("profit"))
