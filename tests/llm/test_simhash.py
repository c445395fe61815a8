import random

import numpy as np
import pytest

from propspark.llm import common, simhash
from propspark.llm.simhash import block_masks, covering_masks, fingerprint, fingerprint_links, simhash_groups
from tests_llm_helpers import brute_groups


@pytest.mark.parametrize("radius", [1, 2])
def test_masks_cover_every_choice_of_bits(radius):
    from itertools import combinations

    for masks in (covering_masks(radius), block_masks(radius, 4 * radius)):
        for bits in combinations(range(64), radius):
            flipped = sum(1 << b for b in bits)
            assert any(m & flipped == 0 for m in masks)


def test_fingerprint_of_few_words():
    import xxhash

    assert fingerprint("", 3) == 0 == fingerprint(" \t\n", 3)
    assert fingerprint("One\x0btwo", 3) == xxhash.xxh64_intdigest(b"one two", 42)
    assert fingerprint("É a b", 3) == xxhash.xxh64_intdigest("É a b".encode(), 42)


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = set(seeds)
    for s in seeds[:6]:
        for _ in range(8):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = {simhash.signed(v): v for v in values}
    links = fingerprint_links(spark.createDataFrame([(k,) for k in fps], "fp long")).collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 64 for r in links)
    root = {k: k for k in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    want = brute_groups({k: v for k, v in fps.items()})
    assert {k: find(k) for k in fps} == want


def test_groups_of_sf_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = {r.doc_id: fingerprint(r.text or "", 3) for r in docs.collect()}
    want = brute_groups(fps)
    got = simhash_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}


def test_nulls_ties_long_and_clashing_columns(spark):
    rows = [(5, None, "a"), (4, "", "b"), (7, "same words here now", "c"), (7, "same words here now", "c"), (9, "x " * 100_000, "d"), (None, "same words here now", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_groups(df).collect())
    assert got == [(-1, 7), (4, 4), (5, 4), (7, 7), (7, 7), (9, 9)]
    assert simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_looking_up_equals_comparing_all_pairs(radius):
    rng = np.random.default_rng(radius)
    for mask in simhash.block_masks(radius, 4 * radius)[:3]:
        free = [i for i in range(64) if not mask >> i & 1]
        fixed = int(rng.integers(0, 1 << 63)) & mask
        values = {simhash.signed(fixed | sum(1 << b for b in free if rng.random() < 0.3)) for _ in range(300)}
        x = np.sort(np.array(sorted(values), dtype=np.int64))
        assert (simhash.looked_up(x, radius, free) == simhash.all_pairs(x, radius)).all()


def test_chains_end_in_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    stored = common.store
    monkeypatch.setattr(common, "store", lambda df, label: rounds.append(label) or stored(df, label))
    links = [(i, i + 1) for i in range(1023)] + [(2000 + i, 2001 + i) for i in range(20)] + [(5000, 5000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long"), "chain").collect()}
    assert got == {i: 0 for i in range(1024)} | {2000 + i: 2000 for i in range(21)}
    assert rounds.count("chain-step") <= 12
