"""Running sums, ranks and trailing rows over orders that are long for few keys, or for none.

A window puts all rows of a key in one task. Here the order is cut into ranges instead: Spark
partitions the rows by (keys, order), each range sums up what it adds (rows, sums, highest
and lowest so far), and the sums of the ranges before it, one row each, are joined back. So a
key is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.sources.scratch import kept

#: Rows that a range is meant to hold.
CHUNK_ROWS = 1_000_000


def chunked(df: DataFrame, keys: list[str], order: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """`df`, written in ranges of (keys, order), with the number `_chunk` of each row's range. Rows of one place in the order stay in one range."""
    if not keys and not order:
        raise ValueError("there must be an order")
    parts = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(parts, *keys, *order) if parts > 1 else df.coalesce(1)
    return kept(cut.withColumn("_chunk", F.spark_partition_id()), "ordered")


_WITHIN: dict[str, Callable[[str], Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_MERGED: dict[str, Callable[[str], Column]] = {**_WITHIN, "last": lambda c: F.last(c, ignorenulls=True)}


def _both(how: str, before: Column, own: Column) -> Column:
    if how == "sum":
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)
    return F.coalesce(own, before) if how == "last" else F.greatest(before, own) if how == "max" else F.least(before, own)


def running(df: DataFrame, keys: list[str], order: list[str], made: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """`df` (from `chunked`) with running sum, max, min or last non-null of expressions over the key's rows so far.

    made: name -> (how, expression). before: without the row itself. Null where there is
    nothing yet. `order` must tell a key's rows apart, or equal places get either order.
    """
    held = df.withColumns({f"_v_{n}": c for n, (_, c) in made.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = held.withColumns({f"_o_{n}": _WITHIN[how](f"_v_{n}").over(frame) for n, (how, _) in made.items()})
    at = F.struct(*[F.col(c) for c in order])
    whole = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)) if how == "last" else _WITHIN[how](f"_v_{n}") for n, (how, _) in made.items()}
    parts = held.groupBy(*keys, "_chunk").agg(*[c.alias(f"_w_{n}") for n, c in whole.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a key and range
    starts = parts.select(*keys, "_chunk", *[_MERGED[how](f"_w_{n}").over(earlier).alias(f"_b_{n}") for n, (how, _) in made.items()])
    same = F.col("l._chunk") == F.col("r._chunk")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    met = own.alias("l").join(starts.alias("r"), same, "left")
    return met.select(*[F.col(f"l.{c}") for c in df.columns], *[_both(how, F.col(f"r._b_{n}"), F.col(f"l._o_{n}")).alias(n) for n, (how, _) in made.items()])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "row_no", rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with each row's place in its key's order, from 1, and `_chunk`."""
    return running(chunked(df, keys, order, rows), keys, order, {out: ("sum", F.lit(1).cast("long"))})


def trailing_rows(df: DataFrame, keys: list[str], order: list[str], n: int, made: dict[str, Callable[[Window], Column]], rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with columns over each row and the n - 1 before it, as w_name = f(window).

    Rows are numbered and fall in blocks of consecutive numbers; the last n - 1 rows of a block
    are offered to the next one too, so each block has all that its frames reach.
    """
    size = max(n, rows)
    placed = numbered(df, keys, order, "_no", rows).drop("_chunk")
    block = F.floor(F.col("_no") / size)
    lent = F.when(F.floor((F.col("_no") + n - 1) / size) > block, F.array(block, block + 1)).otherwise(F.array(block))
    spread = placed.select("*", F.explode(lent).alias("_block")).withColumn("_own", F.col("_block") == block)
    w = Window.partitionBy(*keys, "_block").orderBy("_no").rowsBetween(-(n - 1), 0)
    return spread.withColumns({name: f(w) for name, f in made.items()}).where("_own").drop("_no", "_block", "_own")


def order_statistics(df: DataFrame, by: list[str], column: str, shares: list[float], bins: int = 2048) -> dict[tuple, list[float | None]]:
    """Exact quantiles per group, interpolated between neighbours as quantile_cont does: group -> one value a share.

    Each pass counts the values of the interval that still holds a wanted rank in `bins` equal
    bins; the bin with the rank is the next interval, until it holds one value. What comes to
    the driver is a row a bin, whatever the number of rows. Nulls and NaN have no rank. The
    number of groups must be small, such as one a column or market.
    """
    spark = df.sparkSession
    v = F.col(column).cast("double")
    values = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).where("n > 0").collect()
    wanted, found = {}, {}
    for r in ends:
        group = tuple(r[: len(by)])
        for s in shares:
            for rank in {int(s * (r.n - 1)), min(r.n - 1, int(s * (r.n - 1)) + 1)}:
                if r.low == r.high:
                    found[group, rank] = r.low
                else:
                    wanted[group, rank] = (r.low, r.high, 0)
    kinds = values.schema
    while wanted:
        open_ = sorted({(g, low, high) for (g, _), (low, high, _) in wanted.items()}, key=str)
        spans = spark.createDataFrame([(*g, i, low, high) for i, (g, low, high) in enumerate(open_)], ", ".join([*[f"`{c}` {kinds[c].dataType.simpleString()}" for c in by], "_i int, _low double, _high double"]))
        inside = (F.col("l._v") >= F.col("r._low")) & (F.col("l._v") <= F.col("r._high"))
        for c in by:
            inside = inside & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        met = values.alias("l").join(F.broadcast(spans).alias("r"), inside)
        at = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * bins))
        counts = met.groupBy("_i", at.alias("_bin")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
        held: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["_i"], r["_bin"])):
            held.setdefault(r["_i"], []).append(r)
        number = {x: i for i, x in enumerate(open_)}
        for (g, rank), (low, high, below) in list(wanted.items()):
            for r in held[number[g, low, high]]:
                if below + r.n > rank:
                    if r.low == r.high:
                        found[g, rank] = r.low
                        del wanted[g, rank]
                    else:
                        wanted[g, rank] = (r.low, r.high, below)
                    break
                below += r.n
    out = {}
    for r in ends:
        group, row = tuple(r[: len(by)]), []
        for s in shares:
            exact = s * (r.n - 1)
            a, b = found[group, int(exact)], found[group, min(r.n - 1, int(exact) + 1)]
            row.append(a + (b - a) * (exact - int(exact)))
        out[group] = row
    return out
