"""Keyed state: settlement that waits for a day to close, nearest quotes, and latest prices that expire.

State lives in Spark's RocksDB store, a key's part of it in one place; a micro-batch touches
only the keys that it brings. All give the same rows however the input is cut into batches,
and rows that come twice change nothing. Settlement and nearest quotes are streaming
aggregations that go out when the watermark passes a group's close: no Python runs per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from propspark.functions import odds as O

BET, BOX, CLOCK = 0, 1, 2
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with several variables needs this store; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _closing(at: Column) -> Column:
    """`at` as an event time: a streaming aggregation by it holds a group until the watermark passes its value."""
    return at.cast("timestamp").alias("x_closes", metadata={"spark.watermarkDelayMs": 0})


def settle_stream(
    bets: DataFrame,
    box: DataFrame,
    keys: list[str],
    stats: list[str],
    line: str,
    side: str,
    payout: str,
    ids: tuple[str, str],
    at: str,
    closes: Column,
    delay: str,
    clock: DataFrame | None = None,
    final: Callable[[Column], Column] = lambda total: total,
) -> DataFrame:
    """Streams of bets and of partial box scores -> every bet once, with actual, result and profit.

    A key (a player's day) closes at `closes`, an expression over both streams that is one time
    for all rows of a key and lies behind the `at` of all of them. Until then its bets wait and
    its box rows are summed, whichever comes first and in whatever batches; when the watermark,
    `delay` behind the latest `at`, passes the close, the bets are settled on the whole sum,
    those without any box row with nulls. Rows that repeat an id (`ids`: of bets and of box
    rows) are dropped, as are rows that come later than the delay. `clock`, a stream with `at`,
    moves the watermark where the other streams have ended. `final` is applied to the sum of
    `stats`. Rows without a key never meet those with one.
    """
    others = [c for c in bets.columns if c not in keys and c != at]
    bet, held = F.struct(*others), bets.select(*others).schema
    value = sum((F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in stats[1:]), F.coalesce(F.col(stats[0]).cast("double"), F.lit(0.0)))
    t, none = F.col(at).cast("timestamp"), F.lit(None)
    row = lambda kind, ident, when, v, x: [t.alias("x_at"), F.lit(kind).alias("x_kind"), ident.cast("string").alias("x_id"), when.cast("timestamp").alias("x_when"), v.cast("double").alias("x_value"), x.cast(held).alias("x_bet")]
    both = bets.select(*keys, *row(BET, F.col(ids[0]), closes, none, bet)).unionByName(box.select(*keys, *row(BOX, F.col(ids[1]), closes, value, none)))
    if clock is not None:
        no_key = [none.cast(bets.schema[k].dataType).alias(k) for k in keys]
        both = both.unionByName(clock.select(*no_key, *row(CLOCK, t, none, none, none)))
    once = both.withWatermark("x_at", delay).dropDuplicatesWithinWatermark(["x_kind", "x_id"])
    done = once.select(*keys, _closing(F.col("x_when")), "x_value", "x_bet").groupBy(*keys, "x_closes").agg(F.sum("x_value").alias("x_sum"), F.collect_list("x_bet").alias("x_bets"))
    done = done.select(*keys, F.explode("x_bets").alias("x_bet"), "x_sum").select(*keys, "x_bet.*", F.when(F.col("x_sum").isNotNull(), final(F.col("x_sum"))).alias("actual"))
    done = done.withColumn("result", O.outcome(side, "actual", line))
    return done.withColumn("profit", O.profit("result", payout))


SHARP, SOFT = 0, 1


#: Length of a slot of time, in reaches: quotes of a key wait in the slots that they can meet in.
SLOT = 3


def _nearest(n_keys: int, reach: int):
    """Rows (keys, sharp quotes, soft quotes) -> (keys, sharp_id, soft_id), by one sorted look-up a row."""

    def sorted_quotes(quotes: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        t, i = (quotes.values.field(f).to_numpy() for f in ("t", "i"))
        both = np.unique(np.column_stack([t, i]), axis=0)  # a quote that comes twice is one
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, right = [], [], []
            for k in range(batch.num_rows):
                (t, i), (u, j) = sorted_quotes(batch.column(n_keys)[k]), sorted_quotes(batch.column(n_keys + 1)[k])
                behind = np.searchsorted(u, t)
                after, last = np.minimum(behind, len(u) - 1), np.maximum(behind, 1) - 1
                before = np.searchsorted(u, u[last])  # of equal times, the first has the smallest id
                far = lambda place, there, u=u, t=t: np.where(there, np.abs(u[place] - t), reach + 1)
                a, b = far(before, behind > 0), far(after, behind < len(u))
                best = np.where((a < b) | ((a == b) & (j[before] < j[after])), before, after)
                near = np.minimum(a, b) <= reach
                at.append(np.full(near.sum(), k))
                left.append(i[near])
                right.append(j[best[near]])
            if at:
                which = pa.array(np.concatenate(at))
                columns = [batch.column(c).take(which) for c in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=[*batch.schema.names[:n_keys], "sharp_id", "soft_id"])

    return run


def nearest_stream(sharp: DataFrame, soft: DataFrame, keys: list[str], at: str, id_col: str, minutes: int, delay: str, clock: DataFrame | None = None) -> DataFrame:
    """Streams of quotes -> (keys, sharp_id, soft_id): every sharp quote with the soft one nearest in time within `minutes`, the smaller id on a tie.

    Time is cut into slots of SLOT times `minutes`. A sharp quote waits in its slot, a soft one in
    each that it can reach; a slot goes out when the watermark, `delay` behind the latest time,
    has passed all that can be met in it. So a key's state is spread over its slots, and only
    the pairs that count are made. Ids are longs; a quote without a time or an id meets none.
    `clock` moves the watermark where the other streams have ended.
    """
    reach = minutes * 60_000_000
    slot = SLOT * reach
    t = F.col(at).cast("timestamp")
    micros = F.unix_micros(t)
    of = lambda m: ((m - F.pmod(m, F.lit(slot))) / slot).cast("long")
    slots = {SHARP: F.array(of(micros)), SOFT: F.sequence(of(micros - reach), of(micros + reach)), CLOCK: F.array(F.lit(None).cast("long"))}

    def side(df: DataFrame, kind: int) -> DataFrame:
        known = df if kind == CLOCK else df.where(F.col(at).isNotNull() & F.col(id_col).isNotNull())
        return known.select(*keys, t.alias("x_at"), F.lit(kind).alias("x_kind"), F.struct(micros.alias("t"), F.col(id_col).cast("long").alias("i")).alias("x_quote"), F.explode(slots[kind]).alias("x_slot"))

    both = side(sharp, SHARP).unionByName(side(soft, SOFT))
    if clock is not None:
        nothing = clock.select(*[F.lit(None).cast(sharp.schema[k].dataType).alias(k) for k in keys], at, F.lit(None).cast("long").alias(id_col))
        both = both.unionByName(side(nothing, CLOCK))
    closes = _closing(F.timestamp_micros((F.col("x_slot") + 1) * slot + reach))
    quotes = lambda kind, name: F.collect_list(F.when(F.col("x_kind") == kind, F.col("x_quote"))).alias(name)
    met = both.withWatermark("x_at", delay).select(*keys, closes, "x_kind", "x_quote").groupBy(*keys, "x_closes").agg(quotes(SHARP, "x_sharp"), quotes(SOFT, "x_soft"))
    met = met.select(*keys, "x_sharp", "x_soft").where((F.size("x_sharp") > 0) & (F.size("x_soft") > 0))
    out = T.StructType([*[sharp.schema[k] for k in keys], T.StructField("sharp_id", T.LongType()), T.StructField("soft_id", T.LongType())])
    return met.mapInArrow(_nearest(len(keys), reach), out)


class LatestPrice(StatefulProcessor):
    """First and last price of one key, by time and tie-break; a key that no batch touches for `ttl` is forgotten."""

    FIELDS = ["opened_at", "opened_tie", "opening", "closed_at", "closed_tie", "closing"]

    def __init__(self, keys: list[str], price: T.DataType, ttl: int | None):
        self.keys, self.price, self.ttl = keys, price, ttl

    def schema(self) -> T.StructType:
        kinds = [T.LongType(), T.LongType(), self.price] * 2
        return T.StructType([T.StructField(n, k) for n, k in zip(self.FIELDS, kinds, strict=True)])

    def init(self, handle) -> None:
        self.held = handle.getValueState("price", self.schema(), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ends = [tuple(self.held.get())] if self.held.exists() else []
        for df in rows:
            if df.empty:
                continue
            order = np.lexsort((df["x_tie"].to_numpy(), df["x_at"].to_numpy()))
            first, last = (df.iloc[order[i]] for i in (0, -1))
            plain = lambda r: (int(r["x_at"]), int(r["x_tie"]), None if pd.isna(r["x_price"]) else r["x_price"].item() if hasattr(r["x_price"], "item") else r["x_price"])
            ends.append((*plain(first), *plain(last)))
        if not ends:
            return
        first, last = min(ends, key=lambda e: e[:2]), max(ends, key=lambda e: e[3:5])
        state = (*first[:3], *last[3:])
        self.held.update(state)
        yield pd.DataFrame([(*key, *state)], columns=[*self.keys, *self.FIELDS])

    def close(self) -> None:
        pass


def latest_prices(df: DataFrame, keys: list[str], ts: str, tie: str, price: str, ttl_days: float | None = 30) -> DataFrame:
    """A stream of quotes -> after each batch the opening and latest price of every key that it brought.

    State is one row a key and goes `ttl_days` after the key's last quote (None: never).
    """
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    processor = LatestPrice(keys, df.schema[price].dataType, ttl)
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("x_at"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("x_tie"), F.col(price).alias("x_price")).where("x_at IS NOT NULL")
    out = T.StructType([*[df.schema[k] for k in keys], *processor.schema().fields])
    found = rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Update", "ProcessingTime")
    at = lambda c: F.timestamp_micros(c).alias(c)
    return found.select(*keys, at("opened_at"), "opening", at("closed_at"), "closing")


def write_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's rows to the table at `path`; a batch that is repeated replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def current(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of every key: what is known now."""
    others = [c for c in changes.columns if c not in keys and c != "batch"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_s"))
    return last.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in others])
