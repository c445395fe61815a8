"""Sequence packing by Karmarkar-Karp multiway differencing.

Tokenising and packing run in one pass over the scan, without a shuffle: every
task streams its documents, cuts each one into full windows and smaller parts,
and packs the parts block by block. A block holds a bounded number of parts, so
memory does not depend on the partition. Document texts are never regrouped, so
no key can become hot.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents' ids end with this one.
END_ID = 1
#: Parts that are packed together at most.
BLOCK_PARTS = 512
#: A remainder is cut into parts of this length at most before differencing.
PART_TOKENS = 512
SPECIAL_TEXT = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"

_ENCODERS: dict = {}


def encoder(tokenizer: str, ranks: str):
    """text -> numpy ids of the `tokenizers` file, with its special strings taken as that library takes them.

    The rank file holds the same vocabulary for tiktoken, which gives the same ids
    four times as fast. Texts with the special token's string go to `tokenizers`.
    """
    if (tokenizer, ranks) not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        slow = []

        def encode(text: str) -> np.ndarray:
            if SPECIAL_TEXT in text:
                if not slow:  # loaded only where a text needs it
                    slow.append(Tokenizer.from_file(tokenizer))
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
            return np.array(fast.encode_ordinary(text), dtype="<u4")

        _ENCODERS[tokenizer, ranks] = encode
    return _ENCODERS[tokenizer, ranks]


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of `lengths` in each of `windows` windows, by the largest differencing method.

    Every item starts as a partial partition of its own. The two partial partitions
    with the largest imbalance are merged, the fullest window of one with the emptiest
    of the other, until one is left.
    """
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [(i, None)] + [None] * (windows - 1)))
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        held = [x if y is None else y if x is None else (x, y) for x, y in zip(in_a, reversed(in_b), strict=True)]
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, [held[k] for k in order.tolist()]))
        tie += 1
    out = []
    for held in heap[0][3]:
        own, todo = [], [held]
        while todo:
            x = todo.pop()
            if x is None:
                continue
            if isinstance(x[0], int):
                own.append(x[0])
            else:
                todo += x
        out.append(sorted(own))
    return out


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; their count rises until none is too full."""
    count = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differencing(lengths, count)
        if max(sum(lengths[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        count += max(1, count // 200)


def pack(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_parts: int = BLOCK_PARTS, part_tokens: int = PART_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: where it starts in the document, its length, and its place in a sequence.

    A null text counts as empty; an empty text is its end id alone. Repeated rows and
    repeated or null ids are packed like any other row, each on its own. An empty table
    gives no rows. Columns beside the id and the text are not read. sequence_id is unique
    over the result. with_ids adds the ids of every piece.
    """
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << 40
        parts: list[tuple] = []
        done: list[tuple] = []

        def piece(doc, ids, start, end):
            cut = ids[start:end]
            return (doc, start, end - start, zlib.crc32(cut.tobytes()), len(ids), cut if with_ids else None)

        def place(found: list[list[tuple]]) -> None:
            nonlocal following
            for held in found:
                at, whole = 0, sum(p[2] for p in held)
                for p in held:
                    done.append((*p[:5], following, at, whole, *p[5:][:with_ids]))
                    at += p[2]
                following += 1

        def flush() -> None:
            if parts:
                place([[parts[i] for i in w] for w in windows_of([p[2] for p in parts], capacity)])
                parts.clear()

        def table() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                full = len(ids) - len(ids) % capacity
                place([[piece(doc, ids, k, k + capacity)] for k in range(0, full, capacity)])
                if rest := len(ids) - full:
                    count = -(-rest // part_tokens)
                    cuts = [full + rest * k // count for k in range(count + 1)]
                    parts += [piece(doc, ids, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
                if len(parts) >= block_parts:
                    flush()
                if len(done) >= 20_000 or with_ids and len(done) >= 500:
                    yield table()
        flush()
        if done:
            yield table()

    return columns.mapInArrow(run, PIECES + ", ids array<long>" * with_ids)
