import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlode.core import jstext
from textlode.core.errors import InvalidTokenIntervalError, SentenceRangeError
from textlode.operators import tokens as T

NBSP = "\xa0"


def sentences(text, abbreviations=T.ABBREVIATIONS):
    tk = T.tokenize(text)
    return [T.tokens_text(text, tk, a, b) for a, b in T.Sentences(text, tk, abbreviations).ranges()]


def chunks(text, limit):
    tk = T.tokenize(text)
    return [T.tokens_text(text, tk, a, b) for a, b in T.chunk_ranges(tk, T.Sentences(text, tk), limit)]


@pytest.mark.parametrize(
    ("given", "number"),
    [(" 6 ", 6), ("0x10", 16), ("1e2", 100), ("", None), ("  ", None), ("1_0", None), ("NaN", None), ("12a", None), (".5", 0.5), ("5.", 5), (True, None), (None, None), ("Infinity", None)],
)
def test_numbers_of_text(given, number):
    assert jstext.to_number(given) == number


@pytest.mark.parametrize(("x", "text"), [(5.0, "5"), (1e21, "1e+21"), (0.1, "0.1"), (1e-7, "1e-7"), (123456789.5, "123456789.5"), (-0.0, "0"), (1e20, "100000000000000000000"), (12, "12")])
def test_text_of_numbers(x, text):
    assert jstext.number_text(x) == text


def test_trim_takes_wide_blanks(spark):
    rows = [("\n a\t" + NBSP,), ("\N{IDEOGRAPHIC SPACE}b\N{ZERO WIDTH NO-BREAK SPACE}",), (None,), ("",)]
    df = spark.createDataFrame(rows, "s string").select(jstext.js_trim("s"), jstext.not_blank("s"))
    assert [tuple(r) for r in df.collect()] == [("a", True), ("b", True), (None, None), ("", False)]


def test_utf16_lengths(spark):
    df = spark.createDataFrame([("a\U0001f642b",)], "s string").select(jstext.utf16_length("s"))
    assert df.collect()[0][0] == 4
    assert jstext.utf16_to_codepoint("a\U0001f642b", 3) == 2


def test_tokens_of_kinds_and_runs():
    t = 'A1 "..." é_'
    assert [(t[x.start_pos : x.end_pos], x.token_type) for x in T.tokenize(t)] == [("A", 0), ("1", 1), ('"', 2), ("...", 2), ('"', 2), ("é", 0), ("_", 2)]


def test_newline_flag():
    tk = T.tokenize("One.\r\nTwo")
    assert (tk[2].token_type, tk[2].after_newline, tk[0].after_newline) == (T.WORD, True, False)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dr. Bond asks.\nAnother line?", ["Dr. Bond asks.", "Another line?"]),
        ('He said "Stop!" Next.', ['He said "Stop!"', "Next."]),
        ("First line\nand continues", ["First line\nand continues"]),
        ("", []),
    ],
)
def test_sentence_rule(text, expected):
    assert sentences(text) == expected


def test_no_abbreviations():
    assert sentences("Dr. Smith arrived.", ())[0] == "Dr."


def test_bad_starts():
    tk = T.tokenize("a b")
    s = T.Sentences("a b", tk)
    with pytest.raises(SentenceRangeError):
        s.end_from(2)
    with pytest.raises(IndexError):
        next(s.ranges(3))
    with pytest.raises(InvalidTokenIntervalError):
        T.tokens_text("a b", tk, 0, 3)
    with pytest.raises(IndexError):
        T.token_interval(2, 2)
    assert T.tokens_text("a b", tk, 1, 1) == ""


def test_chunk_goldens():
    assert chunks("This is a sentence. This is a longer sentence. Mr. Bond\nasks\nwhy?", 12) == ["This is a", "sentence.", "This is a", "longer", "sentence.", "Mr. Bond", "asks\nwhy?"]
    assert chunks("aaaa bbbb\ncccc dddd", 9) == ["aaaa bbbb", "cccc dddd"]
    assert chunks("unbreakable", 3) == ["unbreakable"]


def reference_chunks(text, limit):
    """A slow reading of the packing rule, token by token."""
    tk = T.tokenize(text)
    s = T.Sentences(text, tk)
    wide = lambda a, b: tk[b - 1].end_pos - tk[a].start_pos > limit
    at, broken, out = 0, False, []
    while at < len(tk):
        end = s.end_from(at)
        if wide(at, at + 1):
            out.append((at, at + 1))
            broken, at = at + 1 < end, at + 1
            continue
        k = next((t for t in range(at + 1, end) if wide(at, t + 1)), None)
        if k is not None:
            cut = max((t for t in range(at + 1, k + 1) if tk[t].after_newline), default=k)
            out.append((at, cut))
            broken, at = True, cut
            continue
        if not broken:
            while end < len(tk) and not wide(at, s.end_from(end)):
                end = s.end_from(end)
        out.append((at, end))
        broken, at = False, end
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab A.!?\n\"')1 é", max_size=120), st.integers(1, 40))
def test_chunks_as_a_slow_reading_gives_them(text, limit):
    tk = T.tokenize(text)
    found = list(T.chunk_ranges(tk, T.Sentences(text, tk), limit))
    assert found == reference_chunks(text, limit)
    assert [k for a, b in found for k in range(a, b)] == list(range(len(tk)))  # each token in one chunk


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_tokens_hold_all_but_white_space(text):
    held = "".join(text[t.start_pos : t.end_pos] for t in T.tokenize(text))
    assert held == "".join(c for c in text if c not in jstext.WS_CHARS)


def test_tables_of_tokens_sentences_chunks(spark):
    df = spark.createDataFrame([(1, "Hi. There!", 0), (2, None, 0), (3, "", 0), (4, "  ", 0), (1, "Hi. There!", 0)], "k int, text string, idx int")
    assert T.tokens_of(df, "k").groupBy("k").count().collect()[0]["count"] == 8
    assert T.sentences_of(df, "k").filter("k = 1").count() == 4
    got = {(r.k, r.chunk_text) for r in T.chunks_of(df, "k", 1000).collect()}
    assert got == {(1, "Hi. There!"), (3, ""), (4, "  ")}
    assert T.chunks_of(df.limit(0), "k").count() == 0


def test_a_very_long_text():
    text = "word " * 200_000 + "."
    tk = T.tokenize(text)
    assert sum(1 for _ in T.chunk_ranges(tk, T.Sentences(text, tk), 1000)) > 900


def test_context_windows_stay_in_their_document(spark):
    rows = [("a", 0, "Doc1 one."), ("a", 1, "Doc1 two."), ("b", 0, "Doc2 one."), ("b", 1, "Doc2 two.")]
    df = T.with_context(spark.createDataFrame(rows, "d string, n int, t string"), "d", "n", "t", 4, F.lit(" "))
    got = {(r.d, r.n): r.chunk_context for r in df.collect()}
    assert got == {("a", 0): None, ("a", 1): "Previous chunk context:\none.", ("b", 0): None, ("b", 1): "Previous chunk context:\none."}


def test_batches(spark):
    ids = list(range(23))
    random.Random(1).shuffle(ids)
    got = {r.k: r.batch_no for r in T.batches_of(spark.createDataFrame([(i,) for i in ids], "k int"), 5, ["k"]).collect()}
    assert got == {k: k // 5 for k in range(23)}
    with pytest.raises(ValueError):
        T.batches_of(spark.range(1), 0, ["id"])
