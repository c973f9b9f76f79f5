import random

import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm.piece_tokenizer import PieceModel, digests, model_path

MODEL = PieceModel(model_path())
LIB = sentencepiece.SentencePieceProcessor(model_file=model_path())


def same(text):
    ids = MODEL.encode(text)
    assert ids == LIB.encode(text, add_eos=True)
    assert MODEL.decode(ids) == LIB.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "   ", "a", "  two  spaces  ", "\n", "\n\n a\n", "a\tb\r\n;\r", "▁x ▁", "</s><s>", "\x00\x01", "日本語テキスト 🙂🙂", "é", "aaaaaaaaaaaaaaaaaaaaaaa", "https://example.org/a?b=c&d=%20", "ﬁ① x", "=" * 300, "　  x"])
def test_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinorst \n_=-.;{}()\r\t01", max_size=80))
def test_dense_text(text):
    same(text)


def test_long_run_without_spaces():
    rng = random.Random(1)
    same("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé.,") for _ in range(30_000)))


def test_documents(sf):
    for text in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist():
        same(text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decode_of_any_ids(ids):
    assert MODEL.decode(ids) == LIB.decode(ids)


def test_null_empty_and_repeated_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x")]
    out = digests(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 2), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
