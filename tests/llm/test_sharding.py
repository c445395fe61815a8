import zlib
from collections import defaultdict

import numpy as np
import pytest

from propspark.llm import sharding
from propspark.llm.sharding import cut_points, packed, shard_documents, write_shards


def check(rows, docs, shards=24):
    """Every record once, with its size and checksum; slots without gaps; sizes near equal. Returns bytes by shard."""
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    mean = sum(sizes) / shards
    largest = max((r.size for r in rows), default=0)
    assert all(abs(s - mean) <= largest + 0.011 * mean + 1 for s in sizes)
    return sizes


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_hot_groups_are_cut_and_small_ones_stay(spark, monkeypatch, shards):
    """A third of all rows is one text, a third one row over and over: every shard is near the mean still."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 200)
    rng = np.random.default_rng(5)
    docs = [(i, "hot text") for i in range(3000)] + [(7, "the same row")] * 3000
    docs += [(10_000 + i, f"pair {i // 2} " + "x" * int(rng.integers(0, 40))) for i in range(1500)] + [(20_000 + i, f"twin {i // 2}") for i in range(1500)]
    rows = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shards).collect()
    sizes = check(rows, docs, shards)
    assert max(sizes) < 1.03 * sum(sizes) / shards
    places = defaultdict(set)
    for r in rows:
        if r.doc_id >= 20_000:
            places[(r.doc_id - 20_000) // 2].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    assert len({r.shard for r in rows if r.doc_id < 3000}) >= min(shards, shards // 4)


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """One draw a range leaves ranges far too full; they are sampled again until none is."""
    monkeypatch.setattr(sharding, "DRAWS", 1)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('a', cast(id % 90 AS int)) AS text")
    records = sharding.store(sharding.record_keys(docs, sharding.F.col("doc_id")), "t")
    total = records.agg(sharding.F.sum("size")).first()[0]
    first = sharding.with_range(records, cut_points(*sharding.draw(records, sharding.F.col("size") / (2.0 * total) + 0.5 / 20_000, 384, 0), 384))
    found = sharding.with_range(records, sharding.splitters(records, 20_000, total, 24))
    most = lambda df: max(r.n for r in df.groupBy("range").agg(sharding.F.count("*").alias("n")).collect())
    assert most(found) < most(first) and most(found) <= 3 * 2 * 20_000 / 384
    check(shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_tables(spark):
    docs = [(1, None), (1, None), (None, ""), (None, "ä€𝄞"), (2, "y" * 300_000), (3, "z"), (3, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS shard", "3 AS size", "4 AS k1", "5 AS range")
    check(shard_documents(df).collect(), docs)
    assert shard_documents(df.limit(0)).collect() == []
    renamed = df.selectExpr("text AS row", "doc_id AS slot")
    check(shard_documents(renamed, 2, "slot", "row").collect(), docs, 2)


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [sorted((r.doc_id, r.shard, r.slot) for r in shard_documents(docs.repartition(n)).collect()) for n in (1, 6)]
    assert rows[0] == rows[1]


def test_keys_keep_their_order():
    keys = np.array([[-5, 3, 0], [-5, -3, 9], [2**62, 0, 0], [0, 0, 1], [0, 0, 0], [-(2**63), 1, 1]], dtype=np.int64)
    assert [tuple(keys[i]) for i in np.argsort(packed(keys))] == sorted(map(tuple, keys))


def test_files_of_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "'mine' AS slot")
    write_shards(docs, f"{tmp_path}/out", 4, file_rows=20)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted([*docs.columns, "shard", "slot_"])
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    for r in back.groupBy("shard").agg({"slot_": "max", "*": "count"}).collect():
        assert r["max(slot_)"] + 1 == r["count(1)"]
    assert all(r.n <= 20 for r in back.groupBy(sharding.F.input_file_name()).agg(sharding.F.count("*").alias("n")).collect())
    write_shards(docs.limit(0), f"{tmp_path}/none", 4)
