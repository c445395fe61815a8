from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from propspark.llm.secret_scan import find_secrets
from test_near_copies import components as similar
from tests_llm_helpers import check_pieces

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = stage("quality")(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in ids for d in good) >= 0.97 * len(good) and sum(d in ids for d in bad) <= 0.35 * len(bad)

    single = stage("near_dedup")(spark, kept, SF)
    assert single.columns == docs.columns
    groups = similar({r.doc_id: r.text or "" for r in kept.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    clean = stage("secrets")(spark, single, SF)
    before = {r.doc_id: r for r in single.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.schema == single.schema and before.keys() == after.keys()
    for d, r in after.items():
        assert r == before[d] if not find_secrets(before[d].text) else r.text != before[d].text and r.n_chars == len(r.text)

    mix = stage("mixing")(spark, clean, SF)
    assert mix.schema == clean.schema
    rows = mix.collect()
    copies = Counter(r.doc_id for r in rows)
    assert max(copies.values()) <= 2 and all(r == after[r.doc_id] for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in after.values():
        sizes[r.source] += len(r.text.split())
    for r in rows:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())

    by_doc = defaultdict(list)
    pieces = stage("packing")(spark, mix, SF).collect()
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert by_doc.keys() == copies.keys()
    for d, own in by_doc.items():
        assert sum(p.length for p in own) == copies[d] * own[0].doc_tokens
    once = [d for d, n in copies.items() if n == 1]
    check_pieces([p for p in pieces if copies[p.doc_id] == 1], {d: after[d].text for d in once}, 2048, offsets=False)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
A, B = "a b c d e f", "quite another text of some words"


def deduped(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    return sorted(((r.doc_id, r.text) for r in stage("near_dedup")(spark, docs, SF).collect()), key=repr)


def test_dedup_goes_by_row(spark):
    assert deduped(spark, [(1, A), (1, B)]) == [(1, A), (1, B)]  # two texts of one id
    assert deduped(spark, [(0, B), (1, A), (1, B)]) == [(0, B), (1, A)]
    assert deduped(spark, [(1, A), (1, A), (2, A.upper()), (None, A)]) == [(1, A)]
    assert deduped(spark, [(None, A), (None, A), (None, B), (7, None), (8, ""), (9, " \n")]) == [(7, None), (None, A), (None, B)]


def odd_table(spark):
    long = "word number %d of a very long text that goes on and on " * 4000
    rows = [(1, A, "en", "s", 1), (1, A, "en", "s", 1), (1, B, "en", "t", 2), (None, A, None, None, None), (None, None, None, None, None), (5, "", "de", "s", 0), (6, long % tuple(range(4000)), "en", "s", None), (7, "password=abcdef123 and more", "en", "t", 27), (8, "same length tie", "fr", "t", 3), (9, "same length row", "fr", "t", 3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    extra = F.create_map(F.lit("k"), F.array(F.lit(1)))
    return docs.withColumns({"row": F.lit(1), "_copy": F.lit("x"), "copies": F.lit(2.0), "extra": F.lit(True), "key": extra, "_kept": F.lit(1), "component": F.lit(1), "node": F.lit(1), "hit": F.lit(0), "block": F.lit(1), "size": F.lit(1)})


def test_stages_take_any_rows_and_columns(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, nested and clashing columns, no length column."""
    docs = odd_table(spark)
    for table in (docs, docs.drop("n_chars"), docs.limit(0)):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, table, SF)
            rows = out.collect()
            assert name == "packing" or out.columns == table.columns
            assert bool(rows) == bool(table.head(1))
    assert stage("secrets")(spark, docs, SF).count() == docs.count()
    assert stage("near_dedup")(spark, docs, SF).count() == docs.count() - 3  # A but once, null and empty texts are one group
    pieces = stage("packing")(spark, docs, SF).collect()
    assert sum(p.start == 0 for p in pieces) == docs.count()


def test_run_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_work_in_small_batches(spark):
    settings = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 400).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    for name, step in corpus_pipeline.STAGES:
        for key in settings:
            spark.conf.unset(key)
        step(spark, docs.limit(20), SF)
        sizes = [r.size for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches), "size long").collect()]
        assert max(sizes) < 2 << 20 < 3 << 20 < sum(sizes), name
        assert int(spark.conf.get(settings[1])) <= 256, name
