import zlib
from collections import defaultdict

import numpy as np

from propspark.llm.packing import END_ID, encoder
from propspark.llm.queries import tokenizer_files

FILES = tokenizer_files()


def brute_groups(fps):
    """Smallest id reachable for each id, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check_pieces(rows, texts, capacity, offsets=True):
    encode = encoder(*FILES)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.append(encode(text or ""), END_ID).astype("<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_seq.values() if offsets else ():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return {k: sum(r.length for r in v) for k, v in by_seq.items()}
