import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from propspark.llm.packing import encoder, pack, windows_of
from tests_llm_helpers import FILES, check_pieces

SLOW = Tokenizer.from_file(FILES[0])


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizers_library(text):
    assert encoder(*FILES)(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a  b", " \n\n x<|endoftext|>y", "don't  stop\t\t", "x" * 3000, "日本語 ñ   z"])
def test_ids_of_odd_texts(text):
    assert encoder(*FILES)(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_windows_hold_everything_once(lengths):
    found = windows_of(lengths, 64)
    assert sorted(i for w in found for i in w) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in w) for w in found) <= 64


def test_documents_come_back_whole(spark):
    rows = [(i, f"word{i} " * (i * i), "x") for i in range(60)] + [(900, None, "x"), (901, "", "x"), (902, "long text " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    out = pack(df, *FILES).collect()
    lengths = check_pieces(out, {r[0]: r[1] for r in rows}, 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.05 * sum(lengths.values()) + 3 * 2048


def test_repeated_rows_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    out = pack(df, *FILES, with_ids=True).collect()
    assert sorted((r.doc_id is None, r.length, r.ids[-1]) for r in out) == [(False, 3, 1), (False, 3, 1), (True, 1, 1)]
    assert pack(df.limit(0), *FILES).count() == 0


def test_sf_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_pieces(pack(docs, *FILES).collect(), {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert public_tokenizers.path("byte_bpe_50k.json") == FILES[0]
