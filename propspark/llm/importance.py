"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of labelled good documents and one of all
documents, give every document a log weight: the mean of its n-grams' log ratios, times a
number of n-grams that is the same for all. A sum would grow with the length until no
noise could change an order; by the mean a long text weighs as much as a short one of its
kind. Both models are kept for each language, so that a language's share among the good
ones does not weigh. Adding Gumbel noise and keeping the k largest draws k documents
without replacement in proportion to their weights. k is a share of the documents that the
caller states, or else as many as weigh at least what good documents weigh that took no
part in the fit.

The n-grams are four bytes long and hashed into a fixed number of buckets; one more pair
of buckets tells whether a word repeats the word before it, which four bytes cannot see:
text stuck on a word is common in scraped and generated pages and made of sound words. A
bucket's counts are summed by Spark over all documents; only the table of buckets, of fixed
size, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import free_name, language_group, store

#: Hash buckets of byte n-grams; two more count words that differ from, and words that repeat, the one before.
BUCKETS = 1 << 14
HASH_SHIFT = 32 - 14
WIDTH = BUCKETS + 2
#: Languages with models of their own; all others share one more.
LANGUAGES = ("en", "de", "fr", "es")
#: Labelled good documents that are used at most: those whose ids hash lowest.
SAMPLE = 20_000
#: N-grams that every document counts as. Fewer even out the weights, and the draw gets more random.
NGRAMS = 64.0
#: The lowest share of held-out good documents to be ignored where k is not stated, and how far below the rest's smallest log weight the floor lies.
IGNORED_SHARE, MARGIN = 0.001, 4.0
SMOOTHING = 16.0
SEED = 42
#: Fixed point for keys: one millionth.
SCALE = 1_000_000
HISTOGRAM = 4096


class ImportanceModel(NamedTuple):
    ratios: np.ndarray  # log ratio of every bucket, one row for each language group
    ngrams: float  # n-grams that every document counts as
    seed: int  # of the noise
    cut: float  # smallest key that is kept


def buckets_of(text: str) -> tuple[np.ndarray, int, int]:
    """Buckets of all byte 4-grams; words that differ from and that repeat the one before."""
    raw = text.encode("utf-8", "replace")
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    grams = a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24 if len(a) > 3 else a[:0]
    words = raw.split()
    repeats = sum(map(eq, words, words[1:]))
    return (grams * np.uint32(2654435761)) >> np.uint32(HASH_SHIFT), len(words) - repeats, repeats


def log_weight(text: str, ratios: np.ndarray, ngrams: float) -> float:
    """ratios: those of the text's language group. 0 for a text too short for an n-gram."""
    grams, new, repeats = buckets_of(text)
    total = ratios[grams].sum() + new * ratios[BUCKETS] + repeats * ratios[BUCKETS + 1]
    return float(ngrams * total / len(grams)) if len(grams) else 0.0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with language group and flag -> (group_no, bucket, n_all, n_good), one row per bucket that occurs."""
    table = np.zeros((len(LANGUAGES) + 1, 2, WIDTH), dtype=np.int64)
    for batch in batches:
        for text, group, good in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            grams, new, repeats = buckets_of(text.as_py())
            own = np.append(np.bincount(grams, minlength=BUCKETS), [new, repeats])
            table[group, 0] += own
            if good:
                table[group, 1] += own
    groups, at = np.nonzero(table[:, 0])
    yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(at), pa.array(table[groups, 0, at]), pa.array(table[groups, 1, at])], names=["group_no", "bucket", "n_all", "n_good"])


def log_ratios(n_all: np.ndarray, n_good: np.ndarray) -> np.ndarray:
    """Log of good over all probabilities, of the n-gram model and of the repeat model.

    Each bucket's good count and the count to be expected of it get SMOOTHING on top, so
    buckets too rare to tell stay near 0.
    """
    if not n_good.sum():
        return np.zeros(WIDTH)
    parts = []
    for part in (slice(0, BUCKETS), slice(BUCKETS, WIDTH)):
        expected = n_all[part] * (n_good[part].sum() / max(1, n_all[part].sum()))
        parts.append(np.log((n_good[part] + SMOOTHING) / (expected + SMOOTHING)))
    return np.concatenate(parts)


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The largest v with at least k values >= v of a long column, by histograms of fixed size."""
    if k < 1:
        return None
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) // HISTOGRAM + 1
        held = values.where(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("b")).count()
        for b, n in sorted(held.collect(), reverse=True):  # HISTOGRAM rows at most
            if n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= n
        else:
            return low
    return low


def _noise(id_col: str, seed: int) -> F.Column:
    """Standard Gumbel noise, the same for an id in every run with a seed."""
    share = (F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(share))


def _weighed(docs: DataFrame, ratios: np.ndarray, ngrams: float, seed: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([log_weight(t.as_py(), ratios[g], ngrams) for t, g in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "log_weight"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), language_group(docs, lang_col, LANGUAGES).alias("group_no"))
    weighed = picked.mapInArrow(run, "doc_id long, log_weight double")
    return weighed.withColumn("key", F.round((F.col("log_weight") + _noise("doc_id", seed)) * SCALE).cast("long"))


def fit_importance(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    sample: int = SAMPLE,
    ngrams: float = NGRAMS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quality_col: str = "quality",
) -> ImportanceModel:
    """Both models over all of `docs`, and the key from which documents are kept: that of the k-th largest.

    The good documents are those that `labels` gives quality 1, at most `sample` of them;
    of these, ids with an odd hash take no part in the good model. k is `share` of the rows.
    Without a share it is how many rows weigh at least the floor: MARGIN below what all but
    IGNORED_SHARE of the good documents weigh that took no part. Without good documents all
    ratios are 0, and without a share everything is kept.
    """
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    good = good.withColumn("h", F.xxhash64("id", F.lit(SEED))).orderBy("h").limit(sample)
    good = store(good.withColumn("held_out", F.col("h") % 2 != 0).drop("h"), "importance-sample")  # `sample` rows at most
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), language_group(docs, lang_col, LANGUAGES).alias("group_no"))
    flagged = picked.join(F.broadcast(good), "id", "left").select("text", "group_no", F.coalesce(~F.col("held_out"), F.lit(False)).alias("good"))
    sums = flagged.mapInArrow(_counts, "group_no long, bucket long, n_all long, n_good long").groupBy("group_no", "bucket").agg(F.sum("n_all"), F.sum("n_good"))
    table = np.zeros((len(LANGUAGES) + 1, 2, WIDTH))
    for group, bucket, n_all, n_good in sums.collect():  # WIDTH rows for each language group at most
        table[group, :, bucket] = n_all, n_good
    ratios = np.stack([log_ratios(*t) for t in table])
    rows = store(_weighed(docs, ratios, ngrams, seed, id_col, text_col, lang_col), "importance-keys")
    if share is not None:
        k = round(share * rows.count())
    else:
        held = good.where("held_out").select(F.col("id").alias("doc_id"))
        floor = rows.join(F.broadcast(held), "doc_id", "left_semi").agg(F.percentile("log_weight", F.lit(IGNORED_SHARE))).first()[0]
        if floor is None or not table[:, 1].any():
            return ImportanceModel(ratios, ngrams, seed, float("-inf"))
        k = rows.where(F.col("log_weight") >= floor - MARGIN).count()
    cut = kth_largest(rows, "key", k)
    return ImportanceModel(ratios, ngrams, seed, float("inf") if share is not None and not k else float("-inf") if cut is None else float(cut))


def importance_scores(docs: DataFrame, model: ImportanceModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, log_weight, key, kept) for every row of `docs`.

    Null, empty and very short texts weigh 0. Rows that tie at the cut are all kept, so are
    repeated rows of a kept one. Null ids share one noise. Other columns are not read; an
    empty table gives no rows.
    """
    weighed = _weighed(docs, model.ratios, model.ngrams, model.seed, id_col, text_col, lang_col)
    return weighed.withColumn("kept", F.col("key") >= F.lit(model.cut))


def importance_select(docs: DataFrame, model: ImportanceModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that importance_scores() keeps, all columns as they are; no row is shuffled."""
    extra = free_name(docs, "extra")
    at, width, ratios, ngrams, cut = docs.columns.index(text_col), len(docs.columns), model.ratios, model.ngrams, model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extras = batch.column(width).to_pylist()
            keys = (round((log_weight(t.as_py() or "", ratios[x["group_no"]], ngrams) + x["noise"]) * SCALE) for t, x in zip(batch.column(at), extras, strict=True))
            yield batch.filter(pa.array([key >= cut for key in keys], pa.bool_())).select(list(range(width)))

    added = F.struct(language_group(docs, lang_col, LANGUAGES).alias("group_no"), _noise(id_col, model.seed).alias("noise"))
    return docs.withColumn(extra, added).mapInArrow(run, docs.schema)
