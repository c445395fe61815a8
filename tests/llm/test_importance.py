import math

import numpy as np
from pyspark.sql import functions as F

from propspark.llm import importance
from propspark.llm.importance import BUCKETS, buckets_of, fit_importance, importance_scores, importance_select, kth_largest, log_ratios


def test_kth_largest_equals_sorting(spark):
    rng = np.random.default_rng(3)
    values = [*rng.integers(-(10**12), 10**12, 500).tolist(), *[7] * 40, *range(30)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 17, 250, len(values)):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "v", 0) is None and kth_largest(df.limit(0), "v", 3) is None


def test_counts_and_weights_equal_brute_force(spark):
    texts = {i: f"good words number {i} of many\n" * (i % 4 + 1) for i in range(40)} | {i: "### junk junk junk |" * 9 for i in range(40, 50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(50)], "doc_id long, quality int")
    model = fit_importance(docs, labels)
    held = {r.id for r in spark.range(50).selectExpr("id", "xxhash64(id, 42) AS h").collect() if r.h % 2 != 0}
    table = np.zeros((2, BUCKETS + 2))
    for i, t in texts.items():
        grams, new, repeats = buckets_of(t)
        own = np.append(np.bincount(grams, minlength=BUCKETS), [new, repeats])
        table[0] += own
        table[1] += own * (i < 40 and i not in held)
    assert np.allclose(model.ratios[-1], log_ratios(*table)) and not model.ratios[:-1].any()
    assert {r.doc_id for r in importance_scores(docs, model).collect() if r.kept} == set(range(40))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = labels.where("doc_id % 2 = 0")
    model = fit_importance(docs, fitted)
    kept = {r.doc_id: r.kept for r in importance_scores(docs, model).collect()}
    held = [(r.quality, kept[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum(k for q, k in held if q == 1) / sum(q == 1 for q, _ in held) > 0.995
    assert sum(k for q, k in held if q == 0) / sum(q == 0 for q, _ in held) < 0.05
    assert {r.doc_id for r in importance_select(docs, model).collect()} == {d for d, k in kept.items() if k}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, 1.0, "en"), (1, None, 1.0, "en"), (None, "", 2.0, None), (2, "x" * 200_000, 3.0, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra double, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_importance(df, none)
    assert all(r.kept and r.log_weight == 0 for r in importance_scores(df, model).collect())
    out = importance_select(df, model)
    assert out.columns == df.columns and out.count() == 4
    bad = spark.createDataFrame([(None, None), (1, 1), (1, 0)], "doc_id long, quality int")
    assert importance_scores(df, fit_importance(df, bad)).count() == 4
    assert importance_scores(df.limit(0), fit_importance(df.limit(0), bad)).count() == 0


def test_the_draw_follows_the_weights(spark):
    """The largest key is a document's as often, over many seeds, as its share of all weights."""
    weights = {0: 2.0, 1: 1.0, 2: 0.0, 3: 0.5, 4: -1.0}
    docs = spark.createDataFrame(list(weights.items()), "doc_id long, w double")
    runs = 4000
    keyed = docs.crossJoin(spark.range(runs).withColumnRenamed("id", "s")).withColumn("key", F.col("w") + importance._noise("doc_id", F.col("s")))
    drawn = keyed.groupBy("s").agg(F.max_by("doc_id", "key").alias("doc_id")).groupBy("doc_id").count()
    total = sum(map(math.exp, weights.values()))
    found = {r.doc_id: r["count"] / runs for r in drawn.collect()}
    for d, w in weights.items():
        assert abs(found[d] - math.exp(w) / total) < 0.03


def test_share_sample_seed_and_temperature_are_arguments(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")

    def kept(**how):
        rows = importance_scores(docs, fit_importance(docs, labels, **how)).collect()
        plain = sorted(rows, key=lambda r: -r.log_weight)[: sum(r.kept for r in rows)]
        return {r.doc_id for r in rows if r.kept}, {r.doc_id for r in plain}

    drawn, plain = kept(share=0.4)
    assert len(drawn) == round(0.4 * docs.count()) and drawn != plain  # a draw, not the largest weights
    assert kept(share=0.4, seed=7)[0] != drawn
    sharp, plain = kept(share=0.4, ngrams=1e9)
    assert len(sharp & plain) >= 0.98 * len(plain)  # weights so far apart that noise decides nothing
    assert kept(share=0.0)[0] == set()
    assert len(kept(sample=10)[0]) > 0


def test_clashing_columns_and_ties_at_the_cut(spark):
    docs = spark.createDataFrame([(i % 3, "one and the same text", "x", 1.0, 2.0) for i in range(30)], "doc_id long, text string, extra string, log_weight double, key double")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    model = fit_importance(docs, labels, share=0.1)
    rows = importance_scores(docs, model).collect()
    ids = {r.doc_id for r in rows if r.kept}
    assert len(ids) == 1 and sum(r.kept for r in rows) == 10  # repeated rows of a kept one
    out = importance_select(docs, model)
    assert out.columns == docs.columns and out.count() == 10
