"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, hash of the id, row), so equal texts are
neighbours. A sample drawn in proportion to a record's weight gives quantile boundaries of
many ranges, a pass counts every range exactly, and ranges that came out overfull are
sampled again and subdivided. Ranges are small against a shard and bounded in rows and
bytes; with the exact totals of the ranges before it, each range places its own records, and
no shard is ever gathered in one task. Hot groups of equal texts are cut like anything else,
by id and row; small ones stay in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.llm.common import free_name, store

SEED = 42
#: Ranges of a shard at least, and rows that a range is meant to hold.
RANGES_PER_SHARD, RANGE_ROWS = 16, 50_000
#: Samples of a range, and ranges of the whole table at most (beyond it ranges hold more rows).
DRAWS, MAX_RANGES = 24, 1 << 15
#: A range above this many times the mean is overfull, and so often is it subdivided at most.
OVERFULL, ROUNDS = 3.0, 8
#: Equal texts with at most this share of a shard's bytes stay together.
TOGETHER = 0.01
#: Bytes that a record counts beside its text.
RECORD_BYTES = 8

KEYS = ["k1", "k2", "row"]


def record_keys(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2, row): what places a record, without its text; a null text is an empty one.

    `row` is a long that no two rows share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col).cast("long"), F.lit(SEED)).alias("k2"),
        row.alias("row"),
    )


def packed(keys: np.ndarray) -> np.ndarray:
    """Rows of three longs as 24-byte strings of the same order."""
    flipped = keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(flipped.astype(">u8")).view("S24").ravel()


def cut_points(keys: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """At most count - 1 boundaries at equal steps of the sample's weight; a range starts at its boundary.

    A boundary falls on the first record of its text; where a text is so heavy that several
    fall into it, all but the first cut it by id and row.
    """
    if not len(keys) or count < 2:
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    keys, run = keys[order], np.cumsum(weights[order])
    found = keys[np.minimum(np.searchsorted(run, run[-1] * np.arange(1, count) / count), len(keys) - 1)].copy()
    least = np.iinfo(np.int64).min
    first = np.append(True, found[1:, 0] != found[:-1, 0])
    found[first, 1:] = least
    return np.unique(found, axis=0)


def with_range(records: DataFrame, boundaries: np.ndarray) -> DataFrame:
    """`records` with the number of boundaries at or below their key."""
    ends = packed(boundaries) if len(boundaries) else np.zeros(0, dtype="S24")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in KEYS])
            place = np.searchsorted(ends, packed(keys), side="right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "range"])

    return records.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in records.schema.fields] + ["range long"]))


def draw(records: DataFrame, weight: Column, rate: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with a chance of rate * weight each, and what each of them stands for; about `rate` of them come."""
    chance = F.least(F.lit(1.0), weight * F.lit(float(rate)))
    even = F.pmod(F.xxhash64(*KEYS, F.lit(SEED + turn)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = records.select(*KEYS, weight.alias("w"), chance.alias("c")).where(even < F.col("c")).toArrow()
    columns = [rows.column(i).to_numpy() for i in range(5)]
    return np.column_stack(columns[:3]).astype(np.int64).reshape(-1, 3), columns[3] / columns[4]


def splitters(records: DataFrame, n: int, total: int, shards: int) -> np.ndarray:
    """Boundaries of ranges that are small in bytes and in rows.

    A record weighs its part of all bytes and its part of all rows, half each, so that
    neither grows beyond bounds. Only sampled keys (DRAWS a range) and one total a range
    come to the driver; each round subdivides the ranges that are overfull.
    """
    count = min(MAX_RANGES, max(RANGES_PER_SHARD * shards, -(-n // RANGE_ROWS)))
    weight = F.col("size") / F.lit(2.0 * total) + F.lit(0.5 / n)
    keys, weights = draw(records, weight, DRAWS * count, 0)
    found = cut_points(keys, weights, count)
    for turn in range(1, ROUNDS):
        sums = with_range(records, found).groupBy("range").agg(F.sum(weight).alias("w"), F.count("*").alias("rows")).collect()
        over = {r["range"]: r.w for r in sums if r.w * count > OVERFULL and r["rows"] > 1}
        if not over or len(found) >= 2 * MAX_RANGES:
            break
        ends = packed(found) if len(found) else np.zeros(0, dtype="S24")
        full = with_range(records, found).join(F.broadcast(records.sparkSession.createDataFrame([(k,) for k in over], "range long")), "range")
        keys, weights = draw(full, weight, DRAWS * count, turn)
        at = np.searchsorted(ends, packed(keys), side="right") if len(keys) else np.zeros(0, dtype=np.int64)
        more = [cut_points(keys[at == k], weights[at == k], int(np.ceil(w * count)) + 1) for k, w in over.items()]
        added = np.unique(np.concatenate([found, *more]), axis=0)
        if len(added) == len(found):
            break
        found = added
    return found


def places(records: DataFrame, shards: int) -> DataFrame:
    """`records` (stored) with shard and slot; see `shard_documents`."""
    spark = records.sparkSession
    whole = records.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    if not whole.n:
        return records.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranged = store(with_range(records, splitters(records, whole.n, whole.total, shards)), "sharding-ranges")
    sums = sorted((r["range"], r["rows"], r.bytes) for r in ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect())
    before, at_row, at_byte = [], 0, 0
    for k, rows, size in sums:
        before.append((k, at_row, at_byte))
        at_row, at_byte = at_row + rows, at_byte + size
    offsets = spark.createDataFrame(before, "range long, rows_before long, bytes_before long")  # one row a range
    joined = ranged.join(F.broadcast(offsets), "range")
    order = Window.partitionBy("range").orderBy(*KEYS)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "k1")
    placed = joined.withColumn("end", F.col("bytes_before") + F.sum("size").over(up_to)).withColumn("number", F.col("rows_before") + F.row_number().over(order) - 1)
    placed = placed.withColumn("group_end", F.max("end").over(group)).withColumn("group_size", F.sum("size").over(group))
    small = F.col("group_size") * F.lit(shards) <= F.lit(TOGETHER) * F.lit(float(whole.total))
    middle = F.when(small, F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(whole.total)))).cast("int"))
    placed = store(placed.select(*records.columns, "shard", "number"), "sharding-places")
    starts = placed.groupBy("shard").agg(F.min("number").alias("start"))  # one row a shard
    return placed.join(F.broadcast(starts), "shard").select(*records.columns, "shard", (F.col("number") - F.col("start")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every record's shard and its place there.

    The law is `bytes`: the sizes of shards are near equal, a shard being off by half of a
    group that stays together (TOGETHER of a shard) or half of one record, if that is larger,
    at either end. A null text counts as empty, an empty one as RECORD_BYTES; a very long one
    is never cut, so it may be larger than the rest of its shard. Rows that repeat, share an
    id or have none are records of their own. Fewer records than shards leave shards empty.
    An empty table gives no rows; other columns are not read. grown_shard is null, as it has
    no meaning under this law.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    found = places(store(record_keys(docs, F.monotonically_increasing_id(), id_col, text_col), "sharding-keys"), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 100_000) -> None:
    """Writes all rows and columns of `docs` under `path` in folders shard=0, shard=1 ..., with their slot.

    A file holds at most `file_rows` slots of one shard, in order; no task writes a whole
    shard. A column named shard, slot or part keeps its name, the new one gets a mark behind it.
    """
    row, shard, slot, part = (free_name(docs, c) for c in ("row", "shard", "slot", "part"))
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "sharding-rows")
    keys = store(record_keys(numbered, F.col(row), id_col, text_col), "sharding-keys")
    found = places(keys, shards).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = numbered.join(found, row).withColumn(part, F.floor(F.col(slot) / file_rows)).drop(row)
    files = found.select(shard, F.floor(F.col(slot) / file_rows)).distinct().count()
    out = out.repartition(max(1, files), shard, part).sortWithinPartitions(shard, part, slot).drop(part)
    out.write.partitionBy(shard).parquet(path)

