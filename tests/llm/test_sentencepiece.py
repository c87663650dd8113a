import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.q_sentencepiece import model_path, op1_sentencepiece
from millrace.llm.sentencepiece_bpe import load, tokenize

V = load(model_path())
TEXTS = ["", " ", "  a", "   ", "a  b\n\tc\x00d", " é日\U0001f600 ▁x▁▁ y", "▁", "<s> </s> <0x41>", "�", "word " * 3000, "日本語" * 4000, "x" * 5000, "   q"]


def library(text):
    ids = V.library.encode(text, add_bos=True, add_eos=True)
    return ids, V.library.decode(ids)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(text):
    (ids,), (agrees,) = V.encode([text])
    assert (ids.tolist(), V.decode(ids)) == library(text)
    assert agrees


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\nthe")), max_size=60))
def test_equals_library_on_any_text(text):
    (ids,), _ = V.encode([text])
    assert (ids.tolist(), V.decode(ids)) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12))
def test_decodes_any_ids(ids):
    assert V.decode(np.array(ids, "<u4")) == V.library.decode(ids)


def test_agenda_of_the_whole_text_equals_its_stretches():
    text = "▁The▁quick  brown fox".replace(" ", "▁")
    whole = V.agenda("▁" + text)
    (parts,), _ = V.encode([text])
    assert parts[1:-1].tolist() == whole


def test_table(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tokenize(df, model_path()).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got) == [(0, library("a b")[0], "a b"), (1, [1, 2], ""), (1, [1, 2], ""), (2, [1, 2], "")]
    assert tokenize(df.limit(0), model_path()).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_sentencepiece(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids, decoded = library(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert got[i].matches_library
