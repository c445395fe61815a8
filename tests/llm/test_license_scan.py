import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propspark.llm.license_scan import BASE_PHRASES, CLOSED, PERMISSIVE, STRONG, UNKNOWN, WEAK, evaluate, scan, scan_licenses


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in places), {label for _, label in places}


@given(st.lists(st.sampled_from(["cc", "by", "CC", "general", "public", "license", "all", "rights", "reserved", "é", "x1", " ", "-", ", ", "\n"]), max_size=40).map("".join))
@settings(max_examples=800, deadline=None)
def test_base_equals_brute_force(text):
    n, starts, base, labels, score = scan(text)
    assert (n, sorted(starts), base) == brute(text)
    assert base <= labels and 0 <= score <= 1


def test_neighbouring_phrases_share_no_word():
    assert scan("cc by cc by, all rights reserved")[1] == [0, 2, 4]


@pytest.mark.parametrize(
    ("text", "names", "score"),
    [
        ("MIT", ["mit"], PERMISSIVE),
        ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only"], PERMISSIVE),
        ("MIT AND GPL-3.0-only", ["mit", "gpl-3.0-only"], STRONG),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0"], WEAK),
        ("MIT OR GPL-3.0 AND LGPL-2.1", ["mit", "gpl-3.0", "lgpl-2.1"], PERMISSIVE),
        ("(MIT OR GPL-3.0) AND LGPL-2.1", ["mit", "gpl-3.0", "lgpl-2.1"], WEAK),
        ("(MIT OR (GPL-3.0", ["mit", "gpl-3.0"], PERMISSIVE),
        ("MIT and", ["mit"], PERMISSIVE),
        ("GPL-3.0 or (", ["gpl-3.0"], STRONG),
        ("foo-1 */ and more", ["foo-1"], UNKNOWN),
        ("CC-BY-NC-4.0", ["cc-by-nc-4.0"], CLOSED),
        ("AND MIT", [], None),
        ("", [], None),
        (")(", [], None),
    ],
)
def test_expressions(text, names, score):
    assert evaluate(text) == (names, score)


@given(st.lists(st.sampled_from(["MIT", "GPL-3.0", "AND", "OR", "WITH", "(", ")", "x"]), max_size=20).map(" ".join))
@settings(max_examples=800, deadline=None)
def test_any_expression_has_a_result(text):
    names, score = evaluate(text)
    assert (score is None) == (not names)


def test_rows_nulls_and_empty_table(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "SPDX-License-Identifier: Apache-2.0 OR MIT", "b"), (3, "x " * 100_000 + "General-Public license", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = sorted(((r.doc_id or -1), r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in scan_licenses(df).collect())
    assert out[0] == (-1, 8, 0, None, "apache-2.0,mit", 1.0)
    assert out[1] == out[2] == (1, 0, 0, None, "", 1.0)
    assert out[3] == (3, 100_003, 1, 100_000, "gpl", STRONG)
    assert scan_licenses(df.limit(0)).count() == 0


def test_sf_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in scan_licenses(docs).collect():
        n, starts, base = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)))
