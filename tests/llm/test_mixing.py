import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from propspark.llm.mixing import mix, mixed


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare the excess by weight until no target is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped.update(over)


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(rows, out, near):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    targets = brute_targets(sizes)
    assert len(out) == len(rows)
    of = {d: (words(t), s) for d, t, s in rows}
    taken = defaultdict(int)
    for r in out:
        size, source = of[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source])
        assert r.target == pytest.approx(targets[source], rel=1e-9)
        assert 0 <= r.taken <= 2 * size and r.taken == r.copies * size
        taken[source] += r.taken
    for s, t in targets.items():
        assert taken[s] == pytest.approx(t, rel=near, abs=near * 100)


def test_sf_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    out = mix(docs).collect()
    check(rows, out, 0.01)
    again = {r.doc_id: r.taken for r in mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_uneven_sources_with_nulls_and_empty_texts(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), ["a", "é", "Z", None][i * i % 4]) for i in range(400)]
    rows += [(1000 + i, None if i % 2 else " \t", "empty") for i in range(5)] + [(2000, "w " * 30_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target")
    check(rows, mix(df).collect(), 0.02)
    copies = {r.doc_id: r.copies for r in mix(df).collect()}
    out = mixed(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {d: c for d, c in copies.items() if c}


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")], "doc_id long, text string, source string")
    out = mix(df).collect()
    assert len(out) == 3 and sum(r.taken for r in out) in (7, 8)
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0
    assert mix(df.selectExpr("doc_id", "'' AS text", "source")).collect()[0].taken == 0


def test_rows_that_share_an_id_and_clashing_columns(spark):
    """Copies go by row: texts of one id have copies of their own, and equal rows share theirs evenly."""
    rows = [(7, "w " * (3 + i % 50), "abc"[i % 3], i % 2, i) for i in range(600)] + [(None, "same text here", "a", 1, 0)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, copies long").withColumn("row", F.array(F.lit(1)))
    out = mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += words(t)
    got = mixed(df)
    assert got.columns == df.columns
    for r in got.collect():
        taken[r.source] += words(r.text)
    for s, t in brute_targets(sizes).items():
        assert taken[s] == pytest.approx(t, rel=0.02)
    assert len(out) == len(rows) and sum(r.taken for r in out) == sum(taken.values())
    equal = [r.copies for r in out if r.doc_id is None]
    assert len(equal) == 300 and max(equal) - min(equal) <= 1
