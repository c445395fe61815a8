import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from propspark.llm import lm_score
from propspark.llm.lm_score import LANGUAGES, NEW, PRIOR, Chunk, cross_entropy_difference, losses, probability, spelling_probability

SF = "/root/testdata/sf0.001"
COLUMNS = ("background_bits", "target_bits", "score")


def tokens(text):
    words = text.encode().lower().split() if text else []
    return [*words, b""] if words else []


def letters(uni):
    """Counts of bytes at, and behind, each byte of the words and the spaces around them."""
    out = Counter()
    for word, n in uni.items():
        raw = b" " + word + b" "
        for i in range(1, len(raw)):
            out.update({raw[i - 1 : i + 1]: n, raw[i - 1 : i]: n})
    return out


def spelled(word, held):
    raw, p = b" " + word + b" ", 1.0
    for i in range(1, len(raw)):
        p *= spelling_probability(held[raw[i - 1 : i + 1]], held[raw[i - 1 : i]])
    return p


def brute(rows, good):
    """(background bits, target bits, score) by dictionaries of words; rows: (id, text, language)."""
    counts = {}

    def grams(text):
        t = tokens(text)
        return Counter(t), Counter(zip([b"", *t], t, strict=False)), len(t)

    for i, text, lang in rows:
        uni, pairs, n = grams(text)
        for model in [0] + [1] * (i in good):
            held = counts.setdefault((lang, model), [Counter(), Counter(), 0])
            held[0] += uni
            held[1] += pairs
            held[2] += n
    spelling = {k: letters(v[0]) for k, v in counts.items()}
    out = []
    for i, text, lang in rows:
        own_uni, own_pairs, own_n = grams(text)
        t, bits, back = tokens(text), [0.0, 0.0], []
        for model in (0, 1):
            uni, pairs, n = counts.get((lang, model), (Counter(), Counter(), 0))
            mine = model == 0 or i in good
            total = n - own_n * mine
            for k, (h, w) in enumerate(zip([b"", *t], t, strict=False)):
                base = spelled(w, spelling.get((lang, model), Counter()))
                low = base if not total else (1 - NEW) * (uni[w] - own_uni[w] * mine) / total + NEW * base
                p = (pairs[h, w] - own_pairs[h, w] * mine + PRIOR * low) / (uni[h] - own_uni[h] * mine + PRIOR)
                if model == 0:
                    back.append(p)
                elif not total:
                    p = back[k]
                bits[model] -= math.log2(p)
        out.append((i, *bits, (bits[1] - bits[0]) / max(1, len(t))))
    return out


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, *[r[c] for c in COLUMNS]) for r in df.collect())


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [1 << 23, 20_000])
def test_losses_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang if r.lang in LANGUAGES else "") for r in docs.collect()]
    good = {i for i, _, _ in rows if i % 2}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _, _ in rows], "doc_id long, quality int")
    near(rows_of(cross_entropy_difference(docs, labels)), sorted(brute(rows, good)))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = rows_of(cross_entropy_difference(docs, labels))
    for n, block in ((1, 1 << 23), (4, 50_000), (13, 5_000)):
        monkeypatch.setattr(lm_score, "BLOCK", block)
        monkeypatch.setattr(lm_score, "CHUNK", block // 3)
        near(rows_of(cross_entropy_difference(docs.repartition(n), labels)), want)


def test_probabilities_add_up():
    """Over all words that occur, and the share of the spelling model that is left to all others."""
    text = "a b a c a b d e a b the of the a " * 3
    t = tokens(text)
    uni, pairs = Counter(t), Counter(zip([b"", *t], t, strict=False))
    held = letters(uni)
    base = {w: spelled(w, held) for w in uni}
    for h in uni:
        p = [probability(pairs[h, w], uni[h], uni[w], len(t), base[w]) for w in uni]
        rest = PRIOR * NEW * (1 - sum(base.values())) / (uni[h] + PRIOR)
        assert sum(p) <= 1 + 1e-9 and sum(p) + rest == pytest.approx(1, abs=1e-9)
    assert sum(probability(0, 0, 0, 0, base[w]) for w in uni) < 1
    for a in (32, 97, 98, 1):
        assert sum(spelling_probability(held[bytes([a, x])], held[bytes([a])]) for x in range(256)) == pytest.approx(1, abs=1e-9)


def test_tokens_are_those_of_bytes_split():
    texts = ["  a B\tc\n", "", " ", "x", "a\x0bb\x0cc  d\r\n e", "a\x1cb\x1fc", "a\xa0b É"]
    chunk = Chunk(pa.array(texts, pa.string()), np.zeros(len(texts), dtype=np.int64))
    assert chunk.n_words.tolist() == [len(t.encode().split()) for t in texts]
    assert len(chunk.doc) == sum(n + 1 for n in chunk.n_words if n)
    keys, n_all, n_good = chunk.counts(np.array([True] + [False] * (len(texts) - 1)))
    letters_of = lambda t: 2 * sum(len(w) + 1 for w in tokens(t))
    assert n_all.sum() == 3 * len(chunk.doc) + sum(map(letters_of, texts)) and n_good.sum() == 3 * 4 + letters_of(texts[0])
    bits = losses(chunk, np.zeros(len(texts), dtype=bool), keys, np.stack([n_all, n_good]), np.zeros((2, 6 << 16)))
    assert (bits[:, [1, 2]] == 0).all() and (bits[:, [0, 3, 4, 5, 6]] > 0).all()


def test_a_text_that_occurs_twice_is_expected(spark):
    """Without its own counts a text is known only where another document has it."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(300)]
    texts += texts[:30]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    loss = {r.doc_id: r.background_loss for r in cross_entropy_difference(docs, labels).collect()}
    twice, once = [loss[i] for i in [*range(30), *range(300, 330)]], [loss[i] for i in range(30, 300)]
    assert max(twice) < min(once)


def test_target_like_documents_score_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scores = {r.doc_id: r.score for r in cross_entropy_difference(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(r.quality, scores[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = np.array([s for q, s in held if q == 1]), np.array([s for q, s in held if q == 0])
    assert (good[:, None] < bad[None, :]).mean() > 0.9


def test_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, None, "en", "x", 1), (1, None, "en", "x", 1), (None, "abc", None, "y", 2), (2, "ab " * 800_000, "de", "z", 3), (3, " \n", "en", "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, block int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = cross_entropy_difference(df, none).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.score) for r in out) == [(-1, 1, 0.0), (1, 0, 0.0), (1, 0, 0.0), (2, 800_000, 0.0), (3, 0, 0.0)]
    assert all(r.background_bits == r.target_bits == 0 for r in out if not r.n_tokens)
    assert cross_entropy_difference(df.limit(0), none).count() == 0
    bad = spark.createDataFrame([(None, 1), (2, 1), (2, None)], "doc_id long, quality int")
    assert {r.score for r in cross_entropy_difference(df, bad).collect()} == {0.0}
    assert cross_entropy_difference(df.withColumnRenamed("doc_id", "name"), none.withColumnRenamed("doc_id", "name"), id_col="name").count() == 5


def test_repeated_rows_expect_each_other(spark):
    df = spark.createDataFrame([(7, "one two three", "en")] * 2 + [(8, "four five six", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    got = rows_of(cross_entropy_difference(df, labels))
    near(got, sorted(brute(rows, {7})))
    assert got[0] == got[1] and got[0][1] < got[2][1]
