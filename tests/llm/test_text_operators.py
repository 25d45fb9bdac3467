import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.core.jstext import WS_CHARS
from textlode.llm import lookalikes as L
from textlode.llm import mojibake as M
from textlode.llm import pieces as P
from textlode.llm import sentences as S
from textlode.llm.sentence_text import Block, key, stop_key

CLEAN = [
    "Plain text.", "«Já não há lã», disse ela. SÃO OBRIGAÇÕES: INFORMAÇÃO E DOAÇÃO. «ATÉ AMANHû!", "Größe, Übermaß und Ärger: „Ist das gefährlich?“, 24,0 °C, 5 µg ± 3", "« Est-ce grave ? » À côté, l’été dernier. ÂGE ET ANTÉCÉDENTS",
    "«Болит. Не сплю», — сказала она. «Группа В» и СССР, 5 °C", "Είχε π.χ. πόνο, ζάλη και αδυναμία;", "这份样本昨天才送到。“很疼。”", "この標本は「痛い。」と訴えた。", "누가 계약했습니까? \"아파요.\"라고", "قال د. سادينا: «لم أعد أشعر بالألم»", "क\N{DEVANAGARI SIGN VIRAMA}य\N{DEVANAGARI VOWEL SIGN AA} क\N{DEVANAGARI VOWEL SIGN O}ई लक\N{DEVANAGARI SIGN VIRAMA}षण थ\N{DEVANAGARI VOWEL SIGN E}? ५०",
    "ใครเป\N{THAI CHARACTER MAITAIKHU}นผ\N{THAI CHARACTER SARA UU}\N{THAI CHARACTER MAI THO}ลงนาม ขนาด 7.4 มก.", "Nhiệt độ là 90,5 °C. ÂM THANH CỦA MÁY ĐÃ ĐƯỢC GHI LẠI", "Każdy sąsiad już „przyszedł”, źródło", "Það er ekki sárt lengur, þýðing staðá íþrótt", "🙂 👩\N{ZERO WIDTH JOINER}⚕\N{VARIATION SELECTOR-16} ¯\\_(ツ)_/¯ SpO₂ € ½", "ማን ፈረመ? ሄደ።", "Mr. O’Neil—“yes”", "α-blocker β2 Ω", "кг/м² Δt", "FICA À DIREITA",
    "Die Umlaute ÄÖÜäöüß sind", "Buchstaben: éèêë", "McÉlroy", "The SoundÉcole app", "x≤y and a≠b", "foo→bar a±b c°d", "price5€each a€b", "10 kΩ, x≤y und z≥w", "foo±bar", "die Buchstaben éèêëàâîïôùûç", "cm³per", "áéíóöőúüű",
]


@pytest.mark.parametrize("text", CLEAN)
def test_sound_texts_stay(text):
    assert M.diagnose(text) is None and M.repair(text) == text


WRONG = ["latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250"]
MEANT = ["Größe der Räume, äußerte sich nicht für den Prüfer", "Le médecin a été refusé à côté — l’été", "Главный врач остался в архиве", "这份样本昨天才送到，还需要核实", "El médico señaló la operación", "“It hurts. I can’t sleep,”", "كانت الحرارة مرتفعة", "Nhiệt độ thấp hơn hôm qua"]


def garble(text, wrong):
    return "".join(_char(b, wrong) for b in text.encode())


def _char(b, wrong):
    try:
        return bytes([b]).decode(wrong)
    except UnicodeDecodeError:
        return chr(b)


@pytest.mark.parametrize("wrong", WRONG)
@pytest.mark.parametrize("text", MEANT)
def test_utf8_read_wrongly_comes_back(text, wrong):
    bad = "Before. " + garble(text, wrong) + " After."
    assert M.diagnose(bad) is not None
    assert M.repair(bad) == "Before. " + text + " After."


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abZ .,!\n" * 3 + "éÉ³Ã¼Â±Θ▄ÐðЀцКЮМ…\N{REPLACEMENT CHARACTER}", max_size=60))
def test_cutting_plain_runs_changes_no_finding(text):
    near = M._condensed(text)
    assert M.utf8_spans(near)[0] == M.utf8_spans(text)[0] and M.shapes(near) == M.shapes(text)


def test_wrong_more_than_once():
    twice = garble(garble("sp\xe4ter f\xfcr 5 \xb5g", "cp1252"), "cp1252")
    assert M.diagnose(twice) and M.repair(twice) == "sp\xe4ter f\xfcr 5 \xb5g"
    assert M.repair(garble(twice, "cp1252")) == "sp\xe4ter f\xfcr 5 \xb5g"


@pytest.mark.parametrize(
    ("text", "true", "wrong"),
    [("Немедленно остановите процедуру", "koi8_r", "latin-1"), ("Главный врач остался", "cp1251", "latin-1"), ("这份样本昨天才送到还需要核实", "gb18030", "latin-1"), ("누가 노르텍연구소와 계약했습니까", "euc_kr", "latin-1"), ("Ein müder Prüfer für das Gerät", "cp850", "cp1252"), ("dépend du résultat, été, fermé", "latin-1", "cp437"), ("Das wurde geöffnet, später für alle", "latin-1", "mac_roman")],
)
def test_other_encodings_are_found_and_restored(text, true, wrong):
    bad = "".join(_char(b, wrong) if b > 127 else chr(b) for b in text.encode(true))
    assert M.diagnose(bad) and M.repair(bad) == text


def test_lost_characters_are_found_but_not_restored():
    assert M.diagnose("sp\N{REPLACEMENT CHARACTER}ter") and "\N{REPLACEMENT CHARACTER}" in M.repair("sp\N{REPLACEMENT CHARACTER}ter")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_repair_takes_any_text(text):
    M.diagnose(text)
    assert isinstance(M.repair(text), str)


def test_garbled_tables(spark):
    rows = [(1, "f\xc3\xbcr", 0), (2, None, 0), (3, "", 0), (4, "ok", 0), (1, "f\xc3\xbcr", 0), (5, "x" * 300_000 + "\xc3\xa4", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, reason int")
    assert sorted(r.doc_id for r in M.find_garbled(df).collect()) == [1, 1, 5]
    assert {(r.repaired, r.restored) for r in M.repair_garbled(df).filter("doc_id = 1").collect()} == {("f\xfcr", True)}
    assert M.find_garbled(df.limit(0)).count() == 0


# Look-alikes

SAME = [
    ("Gala", "Ｇａｌａ"), ("Gala", "G\N{ZERO WIDTH SPACE}al\N{SOFT HYPHEN}a"), ("a b", "a\xa0b"), ("a b", "a\N{EM SPACE} b"), ("Söl", "So\N{COMBINING DIAERESIS}l"), ("Вrеn", "Bren"), ("Jornagh", "Јοrnаɡh"), ("fine", "ﬁne"), ("Å", "\N{ANGSTROM SIGN}"), ("カナ", "ｶﾅ"), ("re-do", "re‐do"),
    ("\N{LATIN SMALL LETTER E WITH CIRCUMFLEX AND DOT BELOW}", "e\N{COMBINING CIRCUMFLEX ACCENT}\N{COMBINING DOT BELOW}"),
]
DIFFERENT = [("Gala", "gala"), ("Sol", "Söl"), ("x2", "x²"), ("a-b", "a–b"), ("a b", "ab"), ("O2", "O₂"), ("Bren", "Brem"), ("½", "1/2"), ("ё", "е")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_what_looks_the_same(a, b):
    assert L.class_string(a) == L.class_string(b) and L.canonical(a) == L.canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_what_looks_different(a, b):
    assert L.class_string(a) != L.class_string(b) and L.canonical(a) != L.canonical(b)


def test_canonical_script():
    assert L.canonical("Stаvenberg") == "Stavenberg"
    assert L.canonical("Гоpадекс") == "Горадекс"
    assert L.canonical("Παλαπουλοs") != ""
    assert L.canonical(None) is None and L.canonical("") == ""
    assert L.canonical("сор", L.LookalikeTrie(["сор"])) == "сор" and L.canonical("сор") == "cop"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_canonical_form_is_settled(text):
    once = L.canonical(text)
    assert L.class_string(once) == L.class_string(text)
    assert L.canonical(once) == once
    assert once == unicodedata.normalize("NFC", once)


def test_trie_with_and_without_budget():
    t = L.LookalikeTrie(["Bren", "Grenz", "Bjö"])
    assert t.search("Вrеn") == ("Bren", 0) and t.search("Brem") is None
    assert t.search("Вrеm", 2) == ("Bren", 2) and t.search("Вrеm", 1) is None and t.search("Bre", 2) == ("Bren", 2) and t.search("zzzz", 4) is None
    assert t.search("Bjo", 1) == ("Bjö", 1) and t.search("Bjó", 1) == ("Bjö", 1)  # accents cost less
    assert list(t.scan("to В\N{ZERO WIDTH SPACE}ren now")) == ["Bren"]
    assert list(L.LookalikeTrie(["Bjo"]).scan("Bjö")) == []  # a letter without its accent isn't a stretch
    assert list(L.LookalikeTrie([]).scan("x")) == []


def test_found_lookalikes(spark):
    e = spark.createDataFrame([(1, 1, "Bren", 0), (2, 1, "Gala", 0), (3, 1, "zzz", 0), (4, 9, "Bren", 0), (5, 1, None, 0), (6, 1, "", 0), (7, 1, "\N{ZERO WIDTH SPACE}", 0), (2, 1, "Gala", 0), (8, 2, "x", 0), (9, None, "Gala", 0)], "extraction_id long, resolve_id long, text string, source_text int")
    s = spark.createDataFrame([(1, "Bren met Ｇａｌａ"), (1, "Bren met Ｇａｌａ"), (2, None), (None, "Gala")], "resolve_id long, source_text string")
    assert sorted(r.extraction_id for r in L.find_lookalikes(e, s).collect()) == [2]
    assert L.find_lookalikes(e.limit(0), s).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_vocabulary_spells_ambiguous_tokens(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "MAX_BROADCAST_WORDS", bound)  # 0: the vocabulary is joined
    texts = spark.createDataFrame([(1, "сор сор cop"), (2, "сор Ｘ"), (3, None), (4, "cop"), (4, "cop"), (5, ""), (6, "cope со\N{ZERO WIDTH SPACE}р")], "k int, t string")
    words = L.vocabulary(texts, "t")
    assert {(r.key, r.spelling) for r in words.collect()} == {("cop", "сор")}
    got = {r.k: r.canonical for r in L.canonical_texts(texts, "k", "t", words).collect()}
    assert got == {1: "сор сор сор", 2: "сор X", 3: None, 4: "сор", 5: "", 6: "cope сор"}


# Pieces


def check_pieces(text, limit, overlap):
    out = P.cut(text, limit, overlap)
    body = text.strip(WS_CHARS)
    if not body:
        assert out == []
        return
    a0 = len(text) - len(text.lstrip(WS_CHARS))
    assert out[0][0] == a0 and out[-1][1] == a0 + len(body)
    overlap = min(overlap, limit - 1)
    for a, b, _ in out:
        assert 0 < b - a <= limit
    for (_, b, _), (c, d, _) in zip(out, out[1:], strict=False):
        assert c == b - overlap and d > b


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!?\n。é\N{COMBINING ACUTE ACCENT}", max_size=150), st.integers(1, 40), st.integers(0, 45))
def test_pieces_cover_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_natural_cuts():
    text = "One two three. Four five six. Seven eight."
    assert [text[a:b] for a, b, _ in P.cut(text, 20, 0)] == ["One two three.", " Four five six.", " Seven eight."]
    assert P.cut("x" * 25, 10, 2)[0] == (0, 10, "hard")
    assert [k for *_, k in P.cut("aaa bbb ccc", 5, 0)] == ["natural", "natural", "end"]
    check_pieces("word " * 100_000, 1000, 100)
    accented = "e\N{COMBINING ACUTE ACCENT}" * 20
    assert all(b % 2 == 0 for _, b, _ in P.cut(accented, 9, 0)) and P.cut(accented, 9, 0)[0] == (0, 8, "hard")
    marks = "e" + "\N{COMBINING ACUTE ACCENT}" * 30
    check_pieces(marks, 8, 2)
    assert P.cut(marks, 8, 0)[0] == (0, 8, "hard")


def test_piece_tables(spark):
    docs = spark.createDataFrame([("a", "x" * 30, {"chunkProfile": "s"}), ("b", "x" * 30, None), ("c", None, None), ("d", "  ", {}), ("e", "x" * 30, {"chunkProfile": "unknown"}), ("f", " " * 40 + "xx", {"chunkProfile": "s"}), ("g", "x" * 10, {"chunkProfile": "s"})], "id string, text string, metadata map<string,string>")
    options = spark.createDataFrame([("s", 10, 2), ("default", 100, 5), ("s", 10, 2)], "profile string, max_char_buffer int, overlap_chars int")
    got = {}
    for r in P.cut_documents(docs, options).collect():
        got.setdefault(r.id, []).append(r.piece)
    assert {k: len(v) for k, v in got.items()} == {"a": 4, "b": 1, "f": 1, "g": 1} and got["f"] == ["xx"]
    assert {r.id for r in P.cut_documents(docs, options, oversized_only=True).collect()} == {"a"}
    assert P.cut_documents(docs.limit(0), options).count() == 0


# Sentences

MODEL = S.Model.prior()


def units(text, model=MODEL):
    return [text[a:b] for a, b in S.split(text, model)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Hello there.", "It rained."], ["It cost 3.5 kg.", "Fine?", "Yes!"], ["It (it was calm! nobody knew) joined.", "Next one."], ["He said: “It hurts. I can’t sleep.”", "Then he left."], ["这份样本昨天才送到。", "谁签署了？", "“很疼。睡不着。”他说。"], ["梓さんは「痛い。眠れない。」と訴えた。", "体温は低い。"],
        ["क\N{DEVANAGARI SIGN VIRAMA}य\N{DEVANAGARI VOWEL SIGN AA} थ\N{DEVANAGARI VOWEL SIGN AA}?", "यह ह\N{DEVANAGARI VOWEL SIGN AI}।", "ठ\N{DEVANAGARI VOWEL SIGN II}क।"], ["Είχε πόνο;", "Ναι."], ["All is well.", "🙂🙂"], ["It broke", ], ["ใครลงนาม", "ไม\N{THAI CHARACTER MAI EK}พบ"], ["She asked, 'Where is it?'", "Nobody knew."], ["He waited... but left.", "So."], ["مريض.", "من وق\N{ARABIC SHADDA}ع؟"], ["¡Ya!", "¿Quién firmó?"],
    ],
)
def test_sentences(parts):
    assert units(" ".join(parts)) == parts


def test_lines_lists_and_headings():
    assert units("Plan\n\n- Take one.\n- Rest\n1) Walk\n2) Run") == ["Plan", "- Take one.", "- Rest", "1) Walk", "2) Run"]
    assert units("This was a\nlong line.") == ["This was a\nlong line."]
    assert units("One.\r\n\r\nTwo") == ["One.", "Two"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB .!?\n\"“”()。1-ก\xa0", max_size=80))
def test_units_hold_every_character(text):
    spans = S.split(text, MODEL)
    held = set()
    last = 0
    for a, b in spans:
        assert last <= a < b and text[a] not in WS_CHARS and text[b - 1] not in WS_CHARS
        held.update(range(a, b))
        last = b
    assert all(c in WS_CHARS for k, c in enumerate(text) if k not in held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-9, 9), st.floats(0.01, 1), st.floats(0.5, 2)), min_size=1, max_size=9), st.sampled_from([1, 3, 64]))
def test_posteriors_of_every_path(gaps, width):
    """Forward-backward against the sum over all sequences of events."""
    odds, link, after = (np.array(x) for x in zip(*gaps, strict=True))
    p, n = 1 / (1 + np.exp(-odds)), len(gaps)
    total, yes = 0.0, np.zeros(n)
    for bits in range(1 << n):
        e = [(bits >> k) & 1 for k in range(n)]
        w = 1.0
        for k in range(n):
            w *= p[k] if e[k] else 1 - p[k]
            if k and e[k - 1]:
                w *= link[k] if e[k] else after[k]
        total += w
        yes += w * np.array(e)
    assert S.posteriors(odds, link, after, width) == pytest.approx(yes / total)


def fitted(spark, rows):
    return S.fit(spark.createDataFrame(list(enumerate(rows)), "id int, text string"))


def stop_odds(model, word):
    k = model.index("stop").find(np.array([stop_key(word)], np.uint64))[0]
    return model.stop_odds[k]


def end_odds(model, word):
    k = model.index("end").find(np.array([key(word)], np.uint64))[0]
    return model.end_odds[k]


def test_the_model_learns_abbreviations_and_headings(spark):
    r = random.Random(1)
    rows = []
    for k in range(300):
        name = "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)).capitalize()
        parts = [f"Herr Xyz. {name} kam an.", "Das war gut.", f"Man sah {name} heute."]
        r.shuffle(parts)
        rows.append((k, "Zusammen\n" + "".join(x + r.choice([" ", " ", "\n"]) for x in parts)))
    df = spark.createDataFrame(rows, "id int, text string")
    model = S.fit(df)
    assert stop_odds(model, "xyz") < -2 and stop_odds(model, "gut") > 0
    assert end_odds(model, "zusammen") > 2 and model.index("end").find(np.array([key("war")], np.uint64))[0] < 0
    for x in rows[:20]:
        out = units(x[1], model)
        assert out[0] == "Zusammen" and len(out) == 4 and any(u.startswith("Herr Xyz. ") for u in out)
    assert S.split_documents(df, model).filter("id = 0").count() == 4


# Sentences of a corpus with stops or line ends; the texts to split have neither.
RUNS = {
    "english": (["The dog barked at night", "We ate dinner at home", "He came home late", "She left the house early", "They sold the old boat", "Nobody knew the answer", "It rained all day"], " ", ". "),
    "chinese": (["我们昨天去了北京", "他今天没有来上班", "你们明天再来看吧", "医生建议病人休息", "她买了三本新书"], "", "。"),
    "japanese": (["私は昨日病院に行きました", "彼は今日来ませんでした", "先生は本を読みます", "明日は雨が降るでしょう", "誰も答えを知りません"], "", "。"),
    "lao": (["ຂ້ອຍໄປຕະຫຼາດ", "ລາວກິນເຂົ້າແລ້ວ", "ພວກເຮົາຮຽນພາສາລາວ", "ມື້ນີ້ຝົນຕົກໜັກ", "ເຈົ້າຢູ່ບ້ານບໍ່"], "", "\n\n"),
}


@pytest.mark.parametrize("name", RUNS)
def test_text_without_stops(spark, name):
    """Units come from the words around a gap where a text has no stops at all."""
    sentences, blank, stop = RUNS[name]
    r = random.Random(3)
    model = fitted(spark, ["".join(x + stop for x in r.choices(sentences, k=6)) for _ in range(150)])
    parts = [sentences[k % len(sentences)] for k in range(14)]
    assert units(blank.join(parts), model) == parts
    # with its stops a text is cut at these alone
    if stop.strip():
        assert [u.rstrip("。.") for u in units("".join(x + stop for x in parts), model)] == parts


def test_neighbouring_events_decide_together():
    """Forward-backward turns the decision of the gap alone: a letter by itself is no unit."""
    text = "He told them so! R. Minor agreed."
    b = Block([text])
    s = S.score(b, MODEL)
    alone, together = s.odds > 0, S.posteriors(s.odds, s.link, s.after_first) > 0.5
    assert (alone != together).sum() == 1 and units(text) == ["He told them so!", "R. Minor agreed."]


TEXTS = ["So. Then", "3. May", "1. Take", "Plan", "“Stop!” he said.", "'", "It broke", "(a b", "x.\n\n5 kg. No", "ไม\N{THAI CHARACTER MAI EK}พบ", "谁？", "A. B. C", "Yes!", "\n", "\N{ZERO WIDTH SPACE}", "a\N{ZERO WIDTH SPACE}. B"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(TEXTS), min_size=1, max_size=8))
def test_a_text_comes_out_the_same_in_any_block(texts):
    b = Block(texts)
    s = S.score(b, MODEL)
    which, start, end = b.spans(np.flatnonzero(S.posteriors(s.odds, s.link, s.after_first) > 0.5))
    for k, t in enumerate(texts):
        assert S.split(t, MODEL) == list(zip(start[which == k].tolist(), end[which == k].tolist(), strict=True))


def test_unclosed_brackets_cost_no_more_than_their_number():
    def seconds(n):
        t0 = time.process_time()
        Block(["(a b. " * n]).quotations
        return time.process_time() - t0

    seconds(1000)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.02)


def test_sentence_tables(spark):
    df = spark.createDataFrame([("a", "One. Two.", 1), ("b", None, 1), ("c", "  ", 1), ("a", "One. Two.", 1), ("d", "word " * 50_000, 1)], "id string, text string, start_pos int")
    got = S.split_documents(df, S.fit(df)).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {"a": 4, "d": 1}
    empty = df.limit(0)
    assert S.split_documents(empty, S.fit(empty)).count() == 0
