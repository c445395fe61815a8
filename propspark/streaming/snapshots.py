"""Quote snapshots as streams. The transformations are those of the batch library; state is
bounded by watermarks. What must wait for other rows of its key is in `state`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from propspark.functions import odds as O
from propspark.sources import io as IO


def stream_snapshots(spark: SparkSession, path: str, schema, keys: list[str], ts: str, delay: str, columns: dict[str, Column] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of snapshots without repeats of a key within the delay."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    df = reader.parquet(path)
    df = df.withColumns(columns) if columns else df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def pre_game(df: DataFrame, captured: str = "captured_at", start: str = "scheduled_start") -> DataFrame:
    """Only quotes captured before the game starts; the same code for batch and stream."""
    return df.where(F.col(start) > F.col(captured))


def quote_windows(df: DataFrame, ts: str, keys: list[str], price: str, size: str, slide: str | None = None) -> DataFrame:
    """Quotes per tumbling or sliding window, with the lowest and highest price."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.min(price).alias("low"), F.max(price).alias("high"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "low", "high", (F.col("high") - F.col("low")).alias("move"))


def edge_sessions(df: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    """How long a flagged edge lasts: captures no further apart than the gap are one session."""
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("captures"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return g.select(*keys, "captures", "first_seen", "last_seen")


def settle(bets: DataFrame, box: DataFrame, keys: list[str], stats: list[str], line: str, side: str, payout: str) -> DataFrame:
    """Bets with actual, result and profit where the box score is there; several rows of a key (two games a day) are summed."""
    actual = box.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in stats])
    total = sum((F.col(s) for s in stats[1:]), F.col(stats[0]))
    out = bets.join(actual.select(*keys, total.cast("double").alias("actual")), keys, "left")
    out = out.withColumn("result", O.outcome(side, "actual", line))
    return out.withColumn("profit", O.profit("result", payout))


def unresolved(bets: DataFrame, box: DataFrame, keys: list[str]) -> DataFrame:
    return IO.new_only(bets, box, keys).agg(F.count("*").alias("unresolved"))


def run_available(
    df: DataFrame,
    checkpoint: str,
    path: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
    seconds: int | None = None,
    idle_batches: bool = True,
) -> StreamingQuery:
    """Runs a stream over what is there, into a table or a function, and waits for it; given `seconds`, no longer than that.

    idle_batches: whether batches without rows run when the watermark has moved. State that
    expires by the clock would ask for them without end, so its streams go without.
    """
    conf, key = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    before = conf.get(key)
    conf.set(key, str(idle_batches).lower())
    try:  # a stream takes the setting when it starts
        started = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    finally:
        conf.set(key, before)
    if seconds is None:
        started.awaitTermination()
    elif not started.awaitTermination(seconds):
        started.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")
    return started
