"""Mixing sources to target token weights by entropy balancing.

Among all document rates that give every source its target of words, those closest in
relative entropy to one copy each are exponentials of the document's size, one multiplier
per source. The multipliers maximise a convex dual; Newton's method finds them for all
sources at once. Each iteration is one aggregation over the counts of documents by source
and size, which is far smaller than the documents. Rates stop at two copies. Rounding
carries each document's error to the next smaller one, within blocks of bounded size, so
a hot source spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propspark.llm.common import free_name, row_key, store, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents that are rounded together on average.
BLOCK_DOCS = 500
ITERATIONS, TOLERANCE = 60, 1e-9


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.as_py().encode("utf-8", "replace").split()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), batch.column(3)], names=["doc_id", "source", "size", "row"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("text"), row_key(docs).alias("row"))
    return picked.mapInArrow(run, "doc_id long, source string, size long, row long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target), one row per source.

    The sources, by code point with null last, take the weights in turn and share `share`
    times all words. A target stops at `most` times its source's size; what is over goes to
    the others by weight. With sources sorted by size over weight, the ones that stop come
    first, so running sums give the level that the others share. The windows run over one
    row per source.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(turn, (F.row_number().over(in_order) - 1) % len(weights)))
    sources = sources.withColumn("limit", most * F.col("source_size")).withColumn("stop", F.col("limit") / F.col("weight"))
    rising = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    sources = sources.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after))
    level = F.min_by(F.when(F.col("level") < F.col("stop"), F.col("level")), F.when(F.col("level") < F.col("stop"), F.struct("stop", F.col("source").isNull(), "source"))).over(whole)
    target = F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))
    return sources.select("source", "n_docs", "source_size", target.alias("target"))


def multipliers(sizes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """`targets` with the multiplier of each source; null where every document takes `most` copies.

    A document of size s has rate min(most, exp(multiplier * s / mean size)). The gap to the
    target rises with the multiplier, so each step keeps a bracket and halves it where
    Newton's step would leave it.
    """
    counts = store(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    full = F.col("target") >= most * F.col("source_size") * (1 - TOLERANCE)
    state = targets.withColumn("mean", F.col("source_size") / F.col("n_docs")).withColumn("multiplier", F.when(~full, F.log(F.col("target") / F.col("source_size"))))
    state = store(state.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf")), "gap": F.lit(None).cast("double")}), "mix-state")
    for _ in range(ITERATIONS):
        at = counts.alias("c").join(state.where("multiplier IS NOT NULL").alias("s"), F.expr("c.source <=> s.source"))
        x, rate = F.col("c.size") / F.col("s.mean"), F.exp(F.col("s.multiplier") * F.col("c.size") / F.col("s.mean"))
        words = F.col("c.n") * F.col("c.size")
        slopes = at.groupBy(F.col("c.source").alias("source")).agg(F.sum(words * F.least(rate, F.lit(float(most)))).alias("got"), F.sum(F.when(rate < most, words * rate * x).otherwise(0.0)).alias("slope"))
        joined = state.alias("s").join(slopes.alias("g"), F.expr("s.source <=> g.source"), "left").select("s.*", "g.got", "g.slope")
        gap = F.col("got") - F.col("target")
        joined = joined.withColumn("gap", gap / F.col("target"))
        joined = joined.withColumn("low", F.when(gap < 0, F.greatest("low", "multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.least("high", "multiplier")).otherwise(F.col("high")))
        step = F.col("multiplier") - gap / F.col("slope")
        open_low, open_high = F.col("low") == float("-inf"), F.col("high") == float("inf")
        halved = F.when(open_high, F.col("low") + 1).when(open_low, F.col("high") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")) & (F.abs(step - F.col("multiplier")) < 2)
        moved = F.when(F.abs("gap") <= TOLERANCE, F.col("multiplier")).when(inside, step).otherwise(halved)
        state = store(joined.withColumn("multiplier", F.when(F.col("multiplier").isNotNull(), moved)).drop("got", "slope"), "mix-state")
        if state.agg(F.coalesce(F.max(F.abs("gap")), F.lit(0.0))).first()[0] <= TOLERANCE:
            break
    return state.select("source", "n_docs", "source_size", "target", "mean", "multiplier")


def round_block(block: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies for the documents of a block, large ones first, each with the error of those before it. n equal rows count as one document n times as long."""
    block = block.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], kind="stable")
    copies, error = [], 0.0
    for size, rate, n in zip(block["size"].tolist(), block["rate"].tolist(), block["n"].tolist(), strict=True):
        if size == 0:
            copies.append(0)
            continue
        wanted = rate * size * n + error
        taken = min(max(round(wanted / size), 0), most * n)
        error = wanted - taken * size
        copies.append(taken)
    return block.assign(copies=copies)[["doc_id", "row", "size", "source_size", "target", "n", "copies"]]


def _copies(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, row, size, source_size, target, n, copies): one row for n equal rows of `docs`, with the copies of them all."""
    if list(weights) != [w for w in weights if w > 0]:
        raise ValueError("weights must be positive")
    sizes = store(word_counts(docs, id_col, text_col, source_col), "mix-sizes")
    targets = store(source_targets(sizes, weights, share, most), "mix-targets")
    solved = multipliers(sizes, targets, most)
    rate = F.when(F.col("s.multiplier").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("s.multiplier") * F.col("d.size") / F.col("s.mean"))))
    blocks = F.ceil(F.col("s.n_docs") / BLOCK_DOCS)
    block = F.pmod(F.xxhash64("d.doc_id", "d.size", "d.row"), blocks).alias("block")
    equal = sizes.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n"))
    rated = equal.alias("d").join(solved.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.row", "d.source", "d.size", "d.n", "s.source_size", "s.target", rate.alias("rate"), block)
    schema = "doc_id long, row long, size long, source_size long, target double, n long, copies long"
    return rated.groupBy("source", "block").applyInPandas(lambda held: round_block(held, most), schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of `docs`; taken is copies times size.

    Null and word-free texts have size 0 and no copies. A null source is a source of its own,
    the last one. Repeated rows and null ids each keep a row, and rows equal in every column
    have copies that differ by one at most. Ties in size go by id, then by a hash of all
    columns, and nothing is random, so reruns agree. An empty table gives no rows.
    """
    found = _copies(docs, weights, share, most, id_col, text_col, source_col)
    each = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")
    found = found.select("doc_id", "size", "source_size", "target", "n", F.col("copies").alias("all"), each)
    copies = F.expr("`all` DIV n + CAST(i <= `all` % n AS INT)").cast("long")
    found = found.select("doc_id", "size", "source_size", "target", copies.alias("copies"))
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as many times as its copies; columns as they are.

    Rows are told apart by all their columns, not by ids, which may be null or repeated; n
    rows equal in every column come as often as all their copies. Documents without words and
    those with no copies do not come. An empty table gives no rows.
    """
    name = free_name(docs, "row")
    found = _copies(docs, weights, share, most, id_col, text_col, source_col).where("copies > 0").select(F.col("row").alias(name), F.col("copies").cast("int"))
    # as many rows as documents, so never broadcast: one plan at every size
    single = docs.withColumn(name, row_key(docs)).dropDuplicates([name])  # before the join, so that equal rows meet in the tasks that read them
    once = single.alias("d").join(found.hint("merge").alias("c"), F.col(f"d.{name}") == F.col(f"c.{name}")).select("d.*", F.col("c.copies").alias(free_name(docs, "copies")))
    count = F.col(free_name(docs, "copies"))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), count)).alias(free_name(docs, "copy"))).select([F.col(f"`{c}`") for c in docs.columns])
