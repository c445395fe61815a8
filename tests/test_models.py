import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from propspark.views import view

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with labelled texts that are empty or null, and labels that are null."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in os.listdir(SF):
        if name not in ("documents.parquet", "labels.parquet"):
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    k = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    text = F.when(k == 1, "").when(k != 2, F.col("text"))
    documents = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.withColumn("quality", F.when(k != 3, F.col("quality"))).write.parquet(f"{folder}/labels.parquet")
    left = documents.join(labels, "doc_id")
    assert left.where("n_chars = 0").count() and left.where("n_chars IS NULL").count() and spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NULL").count()
    return folder


def test_gate_with_empty_texts(spark, odd):
    got = QUERIES["m08_gate"](spark, odd).collect()
    assert sorted((r.train_period, r.arm) for r in got) == [(p, a) for p in (0, 1) for a in ("candidate", "control", "market")]
    assert all(0 <= r.auc <= 1 for r in got)


def rows_of(spark, odd, name):
    """The query's rows by document, after a look that it has one for every label."""
    got = {r.doc_id: r for r in QUERIES[name](spark, odd).collect()}
    assert sorted(got) == sorted(r.doc_id for r in spark.read.parquet(f"{odd}/labels.parquet").collect())
    return got


def test_logistic_scores_empty_texts(spark, odd):
    got = rows_of(spark, odd, "m01_l1_logistic")
    assert all(0 <= r.p_model <= 1 for r in got.values()) and any(r.y is None for r in got.values())


def test_trees_score_empty_texts(spark, odd):
    got = rows_of(spark, odd, "m02_boosted_trees")
    assert all(0 <= r.p_hard <= 1 and r.p_soft is not None for r in got.values())


def test_isotonic_keeps_empty_texts(spark, odd):
    got = rows_of(spark, odd, "m03_isotonic")
    assert any(r.symbols is None for r in got.values())
    assert all((r.calibrated is None) == (r.symbols is None) for r in got.values())


def test_isotonic_never_falls(spark, odd):
    known = sorted((r.symbols, r.calibrated) for r in rows_of(spark, odd, "m03_isotonic").values() if r.symbols is not None)
    assert all(a[1] <= b[1] for a, b in zip(known, known[1:], strict=False))


def test_ensemble_of_empty_texts(spark, odd):
    market = {r.doc_id: r.p for r in view(spark, odd, "scored").collect()}
    model = {r.doc_id: r.p_model for r in QUERIES["m01_l1_logistic"](spark, odd).collect()}
    for i, r in rows_of(spark, odd, "m05_ensemble").items():
        assert r.p_mean == pytest.approx(model[i] if market[i] is None else (model[i] + market[i]) / 2)
