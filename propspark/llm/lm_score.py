"""Language-model scoring by cross-entropy difference.

Two bigram models of words, one of labelled good documents and one of all documents, share
one vocabulary (all byte strings without white space), order and smoothing, so that they
differ in their text alone. Each document is scored without its own counts, which both
models would otherwise know by heart: a text that the corpus holds but once is not expected
by itself, and one that it holds twice is. The score is the mean over a document's tokens
of the target model's loss less the background model's: the lower, the more like the target.

With c counts of a language group, w a word and h the word before it (a mark before the
first and after the last one, which is predicted too),

    P(w | h) = (c(h w) + PRIOR P(w)) / (c(h) + PRIOR)
    P(w)     = (1 - NEW) c(w) / N + NEW S(w)

S spells a word byte by byte up to the space that ends it, by a bigram model of the bytes
of all words of the group, smoothed by 1 / 256. A document's own
spelling stays in it. S adds up to 1 over all words, hence P(w) does, and so does P(w | h),
as c(h) is the sum of c(h w). Counts are exact: an n-gram's key is a 64-bit hash of its
words, under which 10^12 distinct n-grams are expected to hold 30,000 pairs of one key.

Documents are dealt into blocks by a hash of their ids. A block sends each of its n-grams
once, in one list for each range of keys; a range adds up what all blocks sent and answers
each list with one of sums. The tables of counts grow with the corpus, are never collected,
and no n-gram, however common, has more than one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import language_group, text_or_empty

#: Weight of the word model in the bigram model, in words; weight of the spelling model in the word model; weight of a shorter context in spelling, in bytes.
PRIOR, NEW, SPELL_PRIOR = 16.0, 0.1, 4.0
#: Groups with models of their own; all other languages share one more.
LANGUAGES = ("en", "de", "fr", "es")
#: Numbers of pairs of bytes by group come first, then those of single bytes.
ONE_BYTE = (len(LANGUAGES) + 1) << 16
#: Bytes of text in a block, and in a partition of blocks.
BLOCK, PARTITION = 1 << 23, 1 << 26
SEED = 42
#: Bytes of text whose tokens are held at once.
CHUNK = 1 << 19

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_P, *_ = _RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _RANDOM[1:]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and without repeats: sorting takes a third of the time of np.unique's hash table."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each stretch of bytes: a polynomial of random numbers that stand for the bytes."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max(initial=1)) - 1, _P)], dtype=np.uint64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = _BYTES[raw[np.repeat(starts, sizes) + within]] * powers[within]
    sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
    ends = np.cumsum(sizes)
    return mixed_bits((sums[ends] - sums[ends - sizes]) ^ (sizes.astype(np.uint64) * _A))


class Chunk:
    """The tokens of some documents: n_words of each, and by token its document and the keys of its word and pair.

    A document without words has no tokens; all others end in the mark. `first` holds where
    texts begin, `last` where they end. `kind` is a token's word with its language group;
    `letters` holds for every byte of every kind, and the space at its end, a number for
    group, byte before and byte, and one for group and byte before; `of` whose kind it is.
    """

    def __init__(self, texts: pa.Array, groups: np.ndarray):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(flat.buffers()[2], dtype=np.uint8) if sizes.any() else np.zeros(0, dtype=np.uint8)
        starts = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat)].astype(np.int64) if len(flat) else np.zeros(0, dtype=np.int64)
        there = sizes > 0
        doc, starts, sizes = doc[there], starts[there], sizes[there]
        self.n_words = np.bincount(doc, minlength=len(texts))
        some = np.flatnonzero(self.n_words)
        self.last = np.cumsum(self.n_words[some] + 1) - 1
        self.first = np.r_[0, self.last[:-1] + 1] if len(some) else self.last
        self.doc = np.repeat(some, self.n_words[some] + 1)
        at, size, inner = np.zeros(len(self.doc), dtype=np.int64), np.zeros(len(self.doc), dtype=np.int64), np.ones(len(self.doc), dtype=bool)
        inner[self.last] = False
        at[inner], size[inner] = starts, sizes
        group_no = groups[self.doc]
        group = mixed_bits((group_no.astype(np.uint64) + np.uint64(1)) * _A)
        self.word = mixed_bits(word_hashes(raw, at, size) ^ group)
        before = np.roll(self.word, 1)
        before[self.first] = self.word[self.last]
        self.pair = mixed_bits(before * _A + self.word)
        self.group_no, self.total = group_no, mixed_bits(group + _C)  # the key of all tokens of the group
        _, pick, self.kind = np.unique(self.word, return_index=True, return_inverse=True)
        sizes = size[pick]
        self.of = np.repeat(np.arange(len(pick)), sizes + 1)
        within = np.arange(len(self.of)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        ends = within == sizes[self.of]
        byte = np.full(len(self.of), 32, dtype=np.int64)
        byte[~ends] = raw[(at[pick][self.of] + within)[~ends]]
        pairs = group_no[pick][self.of] << 16 | np.where(within == 0, 32, np.roll(byte, 1)) << 8 | byte
        self.letters = np.stack([pairs, ONE_BYTE + (pairs >> 8)])

    def counts(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, and how often they occur in all and in good documents."""
        mine = good[self.doc]
        weights = [np.ones(len(mine)), mine.astype(np.float64)]
        by_kind = [np.bincount(self.kind, weights=w, minlength=self.kind.max(initial=-1) + 1) for w in weights]
        letters, at = np.unique(self.letters.ravel(), return_inverse=True)
        spelled = [np.bincount(at, weights=np.tile(w[self.of], 2), minlength=len(letters)) for w in by_kind]
        keys = np.concatenate([self.word, self.pair, self.total, letter_keys(letters)])
        return added(keys, *(np.concatenate([w, w, w, n]) for w, n in zip(weights, spelled, strict=True)))

    def keys(self) -> np.ndarray:
        """All distinct keys, sorted."""
        return distinct(np.concatenate([self.word, self.pair, self.total, letter_keys(distinct(self.letters.ravel()))]))

    def spelled(self, letters: np.ndarray) -> np.ndarray:
        """Probability of spelling each token's word; letters: counts by number."""
        p = spelling_probability(*letters[self.letters])
        return np.exp2(np.bincount(self.of, weights=np.log2(p), minlength=self.kind.max(initial=-1) + 1))[self.kind]

    def own(self, numbers: np.ndarray) -> np.ndarray:
        """How often each token's number occurs in the token's document."""
        _, at, n = np.unique(self.doc * (numbers.max(initial=0) + 1) + numbers, return_inverse=True, return_counts=True)
        return n[at]

    def context(self, of_word: np.ndarray) -> np.ndarray:
        """From a figure of each token's word that of the word before it."""
        out = np.roll(of_word, 1)
        out[self.first] = of_word[self.last]
        return out


def letter_keys(letters: np.ndarray) -> np.ndarray:
    return mixed_bits(letters.astype(np.uint64) * _B + _A)


def spelling_probability(two, one):
    """Of a byte, from the counts of it behind another byte and of that other byte."""
    return (two + SPELL_PRIOR / 256) / (one + SPELL_PRIOR)


def probability(pair, before, word, total, spelled):
    """P(w | h) from the counts of pair, context, word and all tokens."""
    seen = np.where(total > 0, (1 - NEW) * word / np.maximum(total, 1), 0.0)
    low = np.where(total > 0, seen + NEW * spelled, spelled)
    return (pair + PRIOR * low) / (before + PRIOR)


def losses(chunk: Chunk, good: np.ndarray, keys: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bits of each document under the background and the target model (2 rows), each without the document's own counts.

    keys: sorted; counts, letters: of keys and of pairs of bytes, in all and in good documents
    (2 rows). Without other target text in its group a document is scored by the background alone.
    """
    found, at = np.unique(np.concatenate([chunk.word, chunk.pair, chunk.total]), return_inverse=True)
    word, pair, total = at.reshape(3, -1)
    place = np.searchsorted(keys, found)
    own_word = chunk.own(word)
    own = [chunk.own(pair), chunk.context(own_word), own_word, (chunk.n_words + 1)[chunk.doc]]
    out = np.zeros((2, len(chunk.n_words)))
    background = None
    for m in range(2):
        held = counts[m][place]
        mine = 1 if m == 0 else good[chunk.doc]
        left = [n - o * mine for n, o in zip((held[pair], chunk.context(held[word]), held[word], held[total]), own, strict=True)]
        p = probability(*left, chunk.spelled(letters[m]))
        if m == 0:
            background = p
        else:
            p = np.where(left[3] > 0, p, background)
        out[m] = np.bincount(chunk.doc, weights=-np.log2(p), minlength=len(chunk.n_words))
    return out


def _flags(ids: pa.ChunkedArray, good_ids: pa.ChunkedArray) -> np.ndarray:
    held = good_ids.drop_null()
    return np.array(pc.fill_null(pc.is_in(ids, value_set=held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held, skip_nulls=True), False), dtype=bool)


def chunks_of(docs: pa.Table) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, row after the last, tokens) of runs of rows of about CHUNK bytes."""
    texts, groups = docs["text"].combine_chunks(), np.array(docs["group_no"])
    past = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(past)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield a, b, Chunk(texts[a:b], groups[a:b])


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their counts."""
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, weights=c, minlength=len(found)).astype(np.int64) for c in counts)


def packed(values: np.ndarray) -> bytes:
    """Numbers of 64 bits byte plane by byte plane, compressed; neighbours in a sorted list differ in few planes."""
    return pa.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(raw: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * count, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, count).T).view(np.uint64).reshape(count)


ASKED = "block long, range_no long, n long, keys binary, n_all binary, n_good binary"
ANSWER = "block long, range_no long, n long, n_all binary, n_good binary"


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    names, types = zip(*(c.split() for c in kinds.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64() if t == "long" else pa.binary()) for c, t in zip(columns, types, strict=True)], names=list(names))


def _asked(count: int):
    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        """A block's documents and its good ids -> its n-grams, as differences of sorted keys, and their counts: one row per range of keys."""
        if not docs.num_rows:
            return _table([], ASKED)
        flags = _flags(docs["doc_id"], good["good_id"])
        parts = [chunk.counts(flags[a:b]) for a, b, chunk in chunks_of(docs)]
        keys, n_all, n_good = added(*map(np.concatenate, zip(*parts, strict=True)))
        step, block = (1 << 64) // count, docs["block"][0].as_py()
        ends = [*np.searchsorted(keys, np.array([i * step for i in range(count)], dtype=np.uint64)).tolist(), len(keys)]
        cuts = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
        return _table([(block, i, c.stop - c.start, packed(np.diff(keys[c], prepend=np.uint64(0))), packed(n_all[c]), packed(n_good[c])) for i, c in cuts], ASKED)

    return run


def _answered(lists: pa.Table) -> pa.Table:
    """The lists of one range -> for each block the sums over all blocks, key by key."""
    rows = lists.to_pylist()
    keys = [np.cumsum(unpacked(r["keys"], r["n"]), dtype=np.uint64) for r in rows]
    found, *sums = added(np.concatenate(keys), *(np.concatenate([unpacked(r[c], r["n"]) for r in rows]) for c in ("n_all", "n_good")))
    at = [np.searchsorted(found, k) for k in keys]
    return _table([(r["block"], r["range_no"], r["n"], *(packed(s[i]) for s in sums)) for r, i in zip(rows, at, strict=True)], ANSWER)


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the answers to its lists and its good ids."""
    flags = _flags(docs["doc_id"], answers["good_id"])
    rows = sorted((r for r in answers.drop_columns("good_id").to_pylist() if r["n"] is not None), key=lambda r: r["range_no"])
    counts = np.stack([np.concatenate([unpacked(r[c], r["n"]) for r in rows]).astype(np.int64) for c in ("n_all", "n_good")]) if rows else np.zeros((2, 0))
    keys = distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *(chunk.keys() for _, _, chunk in chunks_of(docs))]))
    every = np.arange(ONE_BYTE + ((len(LANGUAGES) + 1) << 8))
    at = np.minimum(np.searchsorted(keys, letter_keys(every)), max(0, len(keys) - 1))
    letters = np.where(keys[at] == letter_keys(every), counts[:, at], 0) if len(keys) else np.zeros((2, len(every)))
    n, bits = np.zeros(docs.num_rows, dtype=np.int64), np.zeros((2, docs.num_rows))
    for a, b, chunk in chunks_of(docs):
        n[a:b], bits[:, a:b] = chunk.n_words, losses(chunk, flags[a:b], keys, counts, letters)
    per = bits / np.where(n > 0, n + 1, 1)
    return pa.table([docs["doc_id"], *map(pa.array, (n, *bits, *per, per[1] - per[0]))], names=["doc_id", "n_tokens", "background_bits", "target_bits", "background_loss", "target_loss", "score"])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality") -> DataFrame:
    """(doc_id, n_tokens, background_bits, target_bits, background_loss, target_loss, score) for every row of `docs`.

    Tokens are the words between ASCII white space, A-Z in lower case. Bits are a text's total
    loss, losses its mean over the tokens and the end, score is target_loss less
    background_loss. The target is all documents that `labels` gives quality 1. Null, empty
    and word-free texts have 0 throughout. A document whose language group has no target text
    but its own scores by the background alone: 0. Repeated rows are documents of their own,
    which expect each other; null ids have no label. Other columns are not read; an empty
    table gives no rows. The block of a very long text is as large as the text.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    count = size // BLOCK + 1
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION + 1)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(SEED)), F.lit(count))
    row_key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))  # rows without an id are dealt by text
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), language_group(docs, lang_col, LANGUAGES).alias("group_no"))
    dealt = picked.withColumn("block", block(row_key)).repartition(width, "block")  # both passes read this one shuffle
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("long").alias("good_id")).where("good_id IS NOT NULL").distinct().withColumn("block", block(F.col("good_id")))
    asked = dealt.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_asked(count), ASKED)
    sums = asked.groupBy("range_no").applyInArrow(_answered, ANSWER)
    answers = sums.unionByName(good, allowMissingColumns=True)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, "doc_id long, n_tokens long, background_bits double, target_bits double, background_loss double, target_loss double, score double")
