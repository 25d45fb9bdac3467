import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.core.errors import FormatParseError
from textlode.operators import align as A
from textlode.operators.candidates import Resolver, resolve_answers
from textlode.operators.formats import FormatHandler, _deep_json, dump_yaml, parse_yaml, strict_json

H = FormatHandler()


def reads(text, handler=H, strict=False):
    try:
        return handler.parse(text, strict)[0]
    except FormatParseError as e:
        assert e.original_input == text
        return None


@pytest.mark.parametrize(
    "text",
    [
        '{"extractions": []}',
        '[{"text": "a"}]',
        '```json\n{"extractions": [{"a": "b"}]}\n```',
        'Preface\n```json\n{"extractions": []}\n```\nend',
        '```\n[]\n```',
        '```python\n{"extractions": []}\n```',
        '<think>hm</think>\n{"extractions":[]}',
        '\N{ZERO WIDTH NO-BREAK SPACE} {"extractions": [[1]]}',
        '{"extractions": 1, "extractions": []}',
        '{"extractions": [{"t": "\\ud800"}]}',
        '{"extractions": [{"n": ' + "9" * 5000 + "}]}",
    ],
)
def test_answers_that_are_read(text):
    assert reads(text) is not None


@pytest.mark.parametrize(
    "text",
    [
        "", "  ", "nonsense", '{"extractions": {}}', '{"other": []}', '{"extractions": [1]}', '{"extractions": [null]}', "null", "1", '"x"', '{"extractions": [],}',
        "{'extractions': []}", '{"extractions": [{"a": NaN}]}', '{"extractions": [{"a": "x\ny"}]}', '{"extractions": []} extra', '{"extractions": [{"a": 01}]}',
        '```json\n[]\n```\n```json\n[]\n```', '```python\n[]\n```\n```js\n[]\n```', '// c\n{"extractions": []}', '{"extractions": [{"a": .5}]}', '<think>hm {"extractions":[]}',
        '{"extractions": [{"a": Infinity}]}', '{"extractions": [{"a": "\\x"}]}', "[" * 100_000,
    ],
)
def test_answers_that_are_rejected(text):
    assert reads(text) is None


def test_strict_and_options():
    assert reads('[{"a": 1}]', strict=True) is None
    assert reads('<think>x</think>{"extractions":[]}', strict=True) is None
    assert reads('[{"a": 1}]', FormatHandler(allow_top_level_list=False)) is None
    assert reads('{"a": "b"}', FormatHandler(use_wrapper=False)) == [{"a": "b"}]
    assert reads('{"items": []}', FormatHandler(wrapper_key="items")) == []
    assert reads('{"extractions": []}', FormatHandler(strict_fences=True)) is None
    assert reads('```json\n{"extractions": []}\n```', FormatHandler(use_fences=False)) is None


def test_deep_nesting_is_read():
    deep = "[" * 50_000 + "]" * 50_000
    v = strict_json('{"extractions": ' + deep + "}")
    assert isinstance(v["extractions"], list)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(json_values, st.sampled_from([None, 1, 2]))
def test_deep_reader_agrees_with_the_library(value, indent):
    assert _deep_json(json.dumps(value, indent=indent)) == value


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:1 tfnu-.eE\\', max_size=14))
def test_deep_reader_rejects_what_the_library_rejects(text):
    def outcome(f):
        try:
            return True, f(text)
        except ValueError:
            return False, None

    assert outcome(_deep_json) == outcome(strict_json)


def test_yaml_subset():
    text = "extractions:\n  - text: Bob\n    label: person\n    confidence: 0.5\n  - text: \"x: y\"\n"
    h = FormatHandler("yaml")
    assert reads(text, h) == [{"text": "Bob", "label": "person", "confidence": 0.5}, {"text": "x: y"}]
    for bad in ("a:\tb", "extractions:\n      - a: b\n    - c: d", "no colon here", "# only a comment", "extractions: []", "extractions:\n- text: a"):
        assert reads(bad, h) is None, bad
    assert parse_yaml("a: null\nb: ~\nc: true\nd: -1.5\ne: 'q'") == {"a": None, "b": None, "c": True, "d": -1.5, "e": "q"}
    assert dump_yaml({"a": [1, {"b": "c"}], "d": None}) == 'a:\n  - 1\n  -\n    b: "c"\nd: null'


def test_examples_are_written():
    text = H.example([("person", "Bob", {"role": "dev"})])
    assert text.startswith("```json\n") and reads(text) == [{"person": "Bob", "person_attributes": {"role": "dev"}}]


def test_format_parameters():
    h, rest, used = FormatHandler.from_params({"format_type": "yml", "fence_output": False, "accept_match_lesser": True, "strict_fences": None})
    assert (h.format_type, h.use_fences, rest, used) == ("yaml", False, {"accept_match_lesser": True, "strict_fences": None}, ["fence_output", "format_type"])
    assert FormatHandler.from_params({"format_handler": {"useWrapper": False}, "fence_output": True})[0].use_wrapper is False
    with pytest.raises(TypeError):
        FormatHandler.from_params({"fence_output": "yes"})


@pytest.mark.parametrize(
    ("source", "excerpt", "hint", "options", "expected"),
    [
        ("Alice works at OpenAI in Berlin.", "OpenAI", None, {}, ("exact", 15, 21, 1.0)),
        ("Alice works at OpenAI in Berlin.", "openai", None, {}, ("exact", 15, 21, 1.0)),
        ("Alice works at OpenAI in Berlin.", "open-ai", None, {}, ("lesser", 15, 21, 0.95)),
        ("Patients with Type 2 diabetes.", "type-2 diabetes", None, {}, ("lesser", 14, 29, 0.95)),
        ("Alice", "Alyce", None, {"fuzzy": False, "lesser": False}, ("fuzzy", -1, -1, 0.0)),
        ("Hello Alice", "Alice", (6, 11), {}, ("exact", 6, 11, 1.0)),
        ("Alice in Berlin", "Berlin", (-3, 2), {}, ("exact", 9, 15, 1.0)),
        ("x", "  ", None, {}, ("fuzzy", -1, -1, 0.0)),
        ("", "a", None, {}, ("fuzzy", -1, -1, 0.0)),
    ],
)
def test_alignment(source, excerpt, hint, options, expected):
    r = A.align(source, excerpt, hint, A.AlignOptions(**options))
    assert (r.status, r.start, r.end, r.score) == expected


def test_fuzzy_threshold():
    r = A.align("Alice works at OpenAI in Berlin.", "Alice workplace", None, A.AlignOptions(threshold=0.35))
    assert r.status == "fuzzy" and r.score >= 0.35
    with pytest.raises(TypeError):
        A.AlignOptions(threshold=1.5)


def slow_window(source, excerpt, threshold):
    words = [(A.fold_word(m[0]), m.start(), m.end()) for m in A._WORD.finditer(source)]
    want = [A.fold_word(w) for w in A._WORD.findall(excerpt)]
    best = None
    if not words or not want:
        return None
    for a in range(len(words)):
        for length in range(max(1, len(want) - 2), min(len(words), len(want) + 2) + 1):
            if a + length > len(words):
                continue
            pool, shared = list(want), 0
            for w, _, _ in words[a : a + length]:
                if w in pool:
                    pool.remove(w)
                    shared += 1
            score = shared / max(len(want), length)
            if score >= threshold and (best is None or score > best[2]):
                best = (words[a][1], words[a + length - 1][2], score)
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("aa bb cats cat dd as".split()), max_size=14), st.lists(st.sampled_from("aa bb cat dd".split()), max_size=5), st.sampled_from([0.0, 0.34, 0.5, 0.75]))
def test_windows_as_a_slow_search_finds_them(source, excerpt, threshold):
    s, x = " ".join(source), " ".join(excerpt)
    assert A.best_window(s, x, threshold) == slow_window(s, x, threshold)


def test_align_columns(spark):
    rows = [(1, "a Bob b", "Bob", None, None), (2, "a Bob b", "bo-b", None, None), (3, None, "x", None, None), (4, "Bob Bob", "Bob", 4, 7), (5, "Bob", None, None, None), (6, "Bob", "zzz", None, None)]
    df = spark.createDataFrame(rows, "k int, s string, x string, a int, b int")
    got = {r.k: r.alignment and (r.alignment.status, r.alignment.start, r.alignment.end) for r in A.align_columns(df, "s", "x", "a", "b").collect()}
    assert got == {1: ("exact", 2, 5), 2: ("lesser", 2, 5), 3: None, 4: ("exact", 4, 7), 5: None, 6: ("fuzzy", -1, -1)}


def test_resolving_records():
    r = Resolver()
    out = r.resolve("Visit Berlin now", json.dumps({"extractions": [{"span": "", "category": "city", "start": "6", "end": "12", "confidence": "0.8"}]}))
    assert [(x["text"], x["label"], x["confidence"], x["start_pos"]) for x in out] == [("Berlin", "city", 0.8, 6)]
    assert r.resolve("x", '{"extractions": [{"text": "  "}]}') == []
    with pytest.raises(TypeError):
        r.resolve("x", '{"extractions": [{"person": true}]}')


def test_class_based_records_and_order():
    source = "Bob Alice Charlie"
    answer = json.dumps([{"person": "Bob", "person_index": 2, "person_attributes": {"role": "dev"}}, {"person": "Alice", "person_index": 1}, {"person": "Charlie"}])
    out = Resolver(index_suffix="_index").resolve(source, answer)
    assert [x["text"] for x in out] == ["Alice", "Bob"]
    assert json.loads(out[1]["raw"])["attributes"] == {"role": "dev"}
    mixed = Resolver().candidates([{"b": "x", "2": "y", "1": 5.0}, {"text": "first"}])
    assert [(c["text"], c.get("label")) for c in mixed] == [("first", None), ("5", "1"), ("y", "2"), ("x", "b")]


def test_resolver_parameters():
    r, used = Resolver.from_params({"enableFuzzyAlignment": False, "fuzzy_alignment_threshold": 0.5, "suppress_parse_errors": None, "format_type": "yaml"})
    assert (r.align.fuzzy, r.align.threshold, r.suppress_parse_errors, used) == (False, 0.5, False, ["format_type"])
    with pytest.raises(TypeError, match="spelling"):
        Resolver.from_params({"typo": 1})
    with pytest.raises(TypeError):
        Resolver.from_params({"accept_match_lesser": 1})


def test_resolve_answers_table(spark):
    rows = [(1, "Bob here", '[{"text": "Bob"}]'), (2, "x", "broken"), (3, "x", None), (4, None, "[]"), (1, "Bob here", '[{"text": "Bob"}]')]
    df = spark.createDataFrame(rows, "k int, source_text string, model_output string")
    got = [(r.k, r.text, r.parse_error is None) for r in resolve_answers(df, ["k"]).collect()]
    assert sorted(got, key=str) == [(1, "Bob", True), (1, "Bob", True), (2, None, False)]
    assert resolve_answers(df, ["k"], on_error="drop").count() == 2
    assert resolve_answers(df.limit(0), ["k"]).count() == 0
