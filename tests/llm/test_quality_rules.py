import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propspark.llm.quality_rules import CHAR_CLASSES, CLASS_OF_BYTE, COMMON_COUNT, COMMON_WORDS, judge, measures


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


@given(st.lists(st.sampled_from(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "\x85", " ", "|"]), max_size=150).map("".join))
@settings(max_examples=500, deadline=None)
def test_measures_equal_brute_force(text):
    assert measures(text, "en")[0] == brute(text)


@given(st.lists(st.sampled_from("abc"), min_size=8, max_size=80).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_repeats_equal_brute_force(text):
    assert measures(text, "en")[0][4] == brute(text)[4]


def test_word_lists_have_one_length():
    assert {len(set(w)) for w in COMMON_WORDS.values()} == {COMMON_COUNT}
    assert set(CLASS_OF_BYTE.tolist()) <= set(range(len(CHAR_CLASSES)))


def distance(p, q):
    if not sum(p) or not sum(q):
        return None
    x, y = [v / sum(p) for v in p], [v / sum(q) for v in q]
    kl = lambda a, m: sum(u * math.log2(u / v) for u, v in zip(a, m, strict=True) if u)
    mid = [(u + v) / 2 for u, v in zip(x, y, strict=True)]
    return math.sqrt(max(0, (kl(x, mid) + kl(y, mid)) / 2))


def test_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = {k: measures(r.text or "", r.lang) for k, r in rows.items()}
    failed = {k: n[0] < 20 or 100 * n[4] > 30 * n[0] for k, (n, _, _) in found.items()}
    sums = {}
    for k, (_, chars, common) in found.items():
        if not failed[k]:
            c, w = sums.get(rows[k].lang, (0, 0))
            sums[rows[k].lang] = (c + chars, w + common)
    for r in judge(docs).collect():
        numbers, chars, common = found[r.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == numbers == brute(rows[r.doc_id].text or "")
        assert r.base_failed == failed[r.doc_id]
        want = [distance(h.tolist(), s.tolist()) for h, s in zip((chars, common), sums[rows[r.doc_id].lang], strict=True)]
        assert [r.char_distance, r.word_distance] == [w if w is None else pytest.approx(w, abs=1e-9) for w in want]
        far = sum(chars) >= 500 and want[0] > 0.3 or sum(common) >= 100 and want[1] > 0.28
        assert r.kept == (not failed[r.doc_id] and not far)


def test_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "", "en", "y"), (2, "word " * 100_000, "xx", "z"), (3, " ".join(f"w{i}" for i in range(30)), "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, chars string")
    out = judge(df).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in out) == [(-1, 0, 0, True, False), (1, 0, 0, True, False), (1, 0, 0, True, False), (2, 100_000, 100_000, True, False), (3, 30, 0, False, True)]
    assert judge(df.limit(0)).count() == 0
