import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.llm import bpe

PATH = f"{bpe.TOKENIZER_DIR}/{bpe.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids(texts):
    return [np.frombuffer(b, np.int32).tolist() for b in bpe.merge_table(PATH).encode_block(texts)]


TEXTS = [
    "", None, " ", "\n\n  x", "Hello world", "it's we'll I'VE", "  two  blanks \n end ", "aaaaaaaaaaaaaaaa", "ÀÉ Straße 東京は 🙂👩\N{ZERO WIDTH JOINER}⚕\N{VARIATION SELECTOR-16}", "1234567 89", "<|endoftext|>", "a\x1cb", "tab\there",
    "\r\n\r\n", "x" * 5000, "ab " * 3000, " " * 2000, "\N{IDEOGRAPHIC SPACE}x", "é" * 300, "......", "don't", "\x00", "a  b\n c \td",
]


def test_ids_are_those_of_the_library():
    t = library()
    assert ids(TEXTS) == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    t = library()
    assert ids(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_memory_is_bounded_and_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    first = ids(TEXTS)
    assert ids(TEXTS) == first


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a 'é\n\t,1", max_size=40))
def test_chunks_join_to_the_text(text):
    assert "".join(bpe.chunks(text)) == text


def test_table(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (1, "Hello world", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    t = library()
    hello, x = (t.encode(s, add_special_tokens=False).ids for s in ("Hello world", "x"))
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (None, x)], key=str)
    assert {(r.doc_id, r.n_tokens) for r in bpe.count_tokens(df).collect()} == {(1, 2), (2, 0), (3, 0), (None, len(x))}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
