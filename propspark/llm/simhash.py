"""SimHash near-duplicates through covering locality-sensitive hashing.

Equal fingerprints are merged first, so exact copies cost one row. The others are keyed
by bit masks that are built so that any two fingerprints within the radius agree on at
least one whole mask. Small buckets are compared in memory, all pairs. Fingerprints of
larger buckets go on to a covering family that leaves out `radius` of some blocks of bits:
members of its buckets differ in the few bits left out alone, so a bucket has at most as
many as these bits have values (2^16 for a radius of 2), and each member looks its
neighbours up among them. No level compares all pairs of a group that may grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import LOWER_ASCII, components, empty, store, text_or_empty

BITS = 64
SEED = 42
#: Members of a bucket that are compared with each other at most.
BUCKET = 64
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; 0 without words."""
    words = text.encode("utf-8", "replace").translate(LOWER_ASCII).split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, count, CHUNK):
        n = min(CHUNK, count - start)
        columns = [words[start + k : start + k + n] for k in range(min(shingle, len(words)))]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*columns, strict=False)), dtype="<u8", count=n)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), one row per row of `docs`; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks. Bit i has the vector i mod that count + 1 over GF(2); mask v keeps the bits whose vector has an odd product with v.

    Any `radius` vectors are orthogonal to some v other than 0, so that mask keeps none of
    the bits in which two fingerprints within the radius differ.
    """
    count = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if (i % count + 1 & v).bit_count() % 2) for v in range(1, count + 1)]


def block_masks(radius: int, blocks: int) -> list[int]:
    """All masks that leave out `radius` of `blocks` interleaved blocks of bits."""
    return [sum(1 << i for i in range(BITS) if i % blocks not in out) for out in combinations(range(blocks), radius)]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row per fingerprint and mask; the masks lie in one array literal."""
    tables = F.array(*[F.lit(signed(m)) for m in masks])
    return fps.select("fp", F.posexplode(tables).alias("mask_no", "mask")).selectExpr("fp", "mask_no", "fp & mask AS key")


def all_pairs(x: np.ndarray, radius: int) -> np.ndarray:
    """For each of sorted fingerprints the position of the smallest one of its component."""
    near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
    root = np.arange(len(x))
    while True:
        lower = np.where(near, root[None, :], len(x)).min(axis=1)
        if (lower == root).all():
            return root
        root = lower


def looked_up(x: np.ndarray, radius: int, free: list[int]) -> np.ndarray:
    """all_pairs() of fingerprints that differ in the bits `free` alone: each looks up its neighbours by flipping them."""
    codes = sum((x >> bit & 1) << k for k, bit in enumerate(free))
    place = np.full(1 << len(free), -1)
    place[codes] = np.arange(len(x))
    flips = [sum(1 << k for k in held) for r in range(1, radius + 1) for held in combinations(range(len(free)), r)]
    root = np.arange(len(x))
    while True:
        before = root.copy()
        for flip in flips:
            other = place[codes ^ flip]
            there = other >= 0
            root[there] = np.minimum(root[there], root[other[there]])
        root = root[root]
        if (root == before).all():
            return root


def _within(masks: list[int], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each list of fingerprints: every one that is linked to others, with the smallest of its component."""
        for batch in batches:
            a, b = [], []
            for mask_no, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.sort(np.array(held.values, dtype=np.int64))
                free = [i for i in range(BITS) if not masks[mask_no] >> i & 1]
                root = all_pairs(x, radius) if len(x) <= BUCKET else looked_up(x, radius, free)
                linked = root < np.arange(len(x))
                a.append(x[root[linked]])
                b.append(x[linked])
            flat = [np.concatenate(s) if s else np.zeros(0, dtype=np.int64) for s in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1])], names=["a", "b"])

    return run


def _shared(fps: DataFrame, masks: list[int], label: str) -> DataFrame:
    """(mask_no, key, fp, n) of the fingerprints that share a key; n: how many do."""
    keyed = _keyed(fps, masks)
    sizes = keyed.groupBy("mask_no", "key").agg(F.count("*").alias("n")).where("n > 1")
    return store(keyed.join(sizes, ["mask_no", "key"]), f"{label}-shared")


def _links(shared: DataFrame, masks: list[int], radius: int) -> DataFrame:
    lists = shared.groupBy("mask_no", "key").agg(F.collect_list("fp").alias("held")).select("mask_no", "held")
    return lists.mapInArrow(_within(masks, radius), "a long, b long").distinct()


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that join all those within `radius` bits, directly or by way of others."""
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    cover, blocks = covering_masks(radius), block_masks(radius, 4 * radius)
    shared = _shared(fps, cover, "simhash-cover")
    links = _links(shared.where(F.col("n") <= BUCKET), cover, radius)
    large = store(shared.where(F.col("n") > BUCKET).select("fp").distinct(), "simhash-large")
    if empty(large):
        return links
    return links.unionByName(_links(_shared(large, blocks, "simhash-blocks"), blocks, radius))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Rows link at fingerprints that differ in at most `radius` bits; component_id is the
    smallest id reachable. Null and word-free texts have fingerprint zero and link like
    any other. Fewer words than a shingle make one shingle. Repeated rows each keep a row.
    A null id stays null and takes its component's smallest id, null if there is none.
    An empty table gives no rows. Other columns are not read.
    """
    marked = store(fingerprints(docs, shingle, id_col, text_col), "simhash-docs")
    fps = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    found = components(fingerprint_links(fps.select("fp"), radius), "simhash")
    joined = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = store(joined, "simhash-joined")
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = joined.join(smallest, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
