"""Garbled text from a wrong character encoding: finding it and restoring what was meant.

For every wrong decoder the characters of a text are mapped back to legacy
bytes. A byte-structure automaton, compiled to one expression over characters,
finds the maximal spans of well-formed UTF-8 sequences among those bytes, and
those spans alone are decoded; this repeats until no span is left, as text may
have been decoded wrongly more than once. Runs that hold no UTF-8 structure are
tried against the double-byte encodings with their own automata. Single-byte
text read as another single-byte encoding has no byte structure at all; there
the shapes that no script spells (a capital inside a small-letter word, a
graphic sign between letters, letters of two alphabets in a word, inverted
case) only nominate a text: it counts as garbled where one pair of encodings
reads the nominated stretches as words of the letters that its scripts use most.
Characters that no text is written with (U+FFFD, C1 controls) tell by themselves.

Every document is read once, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The decoders that wrong text comes through, by Python's names. latin: cp1252 with the C1 controls of latin-1.
WRONG_DECODERS = ("latin", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "koi8_r", "mac_roman")
# Lead characters that letters of real text never stand behind, so that one two-byte sequence suffices.
SURE_LEADS = {"cp437": None, "cp866": None, "koi8_r": None, "cp850": "\N{BOX DRAWINGS LIGHT DOWN AND HORIZONTAL}\N{BOX DRAWINGS LIGHT VERTICAL AND RIGHT}\N{BOX DRAWINGS LIGHT HORIZONTAL}\N{BOX DRAWINGS LIGHT VERTICAL AND HORIZONTAL}", "mac_roman": "\N{NOT SIGN}\N{SQUARE ROOT}\N{LATIN SMALL LETTER F WITH HOOK}\N{ALMOST EQUAL TO}\N{INCREMENT}"}
# Code points that restored text is made of (no rare letters, which come from chance pairs).
PLAUSIBLE_TWO = "\xa0-\xffĀ-ſƠơƯưƒˆ˜\N{COMBINING GRAVE ACCENT}\N{COMBINING ACUTE ACCENT}\N{COMBINING TILDE}\N{COMBINING HOOK ABOVE}\N{COMBINING DOT BELOW}Ά-ώЁЄІЇА-ёєіїҐґא-ת،؛؟ء-\N{ARABIC SUKUN}٠-٩پچڈڑژکگںھہۃیےۓ۔"
PLAUSIBLE_MORE = "\N{DEVANAGARI SIGN INVERTED CANDRABINDU}-ൿก-๛က-႟ა-ჿሀ-፿Ẁ-ỹ\N{EN QUAD}-\N{NOMINAL DIGIT SHAPES}⁰-ₜ₠-₿℀-⅏←-⋿⌀-⏿─-➿⬀-⯿\N{IDEOGRAPHIC SPACE}-ヿ㐀-鿿가-힣\uf000-\uf8ffﬀ-ﬆ\N{VARIATION SELECTOR-16}\N{ZERO WIDTH NO-BREAK SPACE}-￯\N{REPLACEMENT CHARACTER}\U0001f100-\U0001faff\U00020000-\U0003ffff"


@lru_cache(maxsize=None)
def byte_of(wrong: str) -> dict[str, int]:
    """The byte from 0x80 on that each character of a decoder stands for."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode("cp1252" if wrong == "latin" else wrong)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
    for b in range(0x80, 0xA0):  # bytes that a decoder leaves undefined, or latin-1 as it is, give C1 controls
        out.setdefault(chr(b), b)
    return out


def _class(chars: dict[str, int], lo: int, hi: int) -> str:
    return "[" + re.escape("".join(c for c, b in chars.items() if lo <= b <= hi)) + "]"


@dataclass(frozen=True)
class SpanAutomaton:
    """Maximal spans of UTF-8 sequences in the characters of one wrong decoder."""

    wrong: str
    pattern: re.Pattern[str]
    leads: frozenset[str]
    trails: frozenset[str]

    @classmethod
    def of(cls, wrong: str) -> SpanAutomaton:
        m = byte_of(wrong)

        def c(lo: int, hi: int) -> str:
            return _class(m, lo, hi)

        t = c(0x80, 0xBF)
        # The well-formed byte sequences of UTF-8.
        forms = [
            c(0xC2, 0xDF) + t,
            c(0xE0, 0xE0) + c(0xA0, 0xBF) + t,
            "(?:" + c(0xE1, 0xEC) + "|" + c(0xEE, 0xEF) + ")" + t + t,
            c(0xED, 0xED) + c(0x80, 0x9F) + t,
            c(0xF0, 0xF0) + c(0x90, 0xBF) + t + t,
            c(0xF1, 0xF3) + t + t + t,
            c(0xF4, 0xF4) + c(0x80, 0x8F) + t + t,
        ]
        chars = lambda lo, hi: frozenset(x for x, b in m.items() if lo <= b <= hi)
        return cls(wrong, re.compile("(?:" + "|".join(forms) + ")+"), chars(0xC2, 0xF4), chars(0x80, 0xBF))

    def decode(self, span: str) -> str:
        m = byte_of(self.wrong)
        return bytes(m[c] for c in span).decode("utf-8")

    def spans(self, text: str, sure: bool = False) -> Iterator[tuple[int, int, str]]:
        """(start, end, decoded) of the credible spans; once a text is ``sure`` to have come through this decoder, of all that decode to plausible text."""
        for s in self.pattern.finditer(text):
            d = self.decode(s[0])
            if self._credible(text, s.start(), s[0], d) or sure and self._likely(text, s.start(), s[0], d):
                yield s.start(), s.end(), d

    def _likely(self, text: str, at: int, span: str, decoded: str) -> bool:
        if not _PLAUSIBLE.fullmatch(decoded):
            return False
        before = text[at - 1 : at]
        if self.wrong in ("cp866", "koi8_r"):
            return bool(_BOX.search(span))
        if self.wrong in ("cp1251", "cp1253"):
            return not ("\N{GREEK CAPITAL LETTER ALPHA}" <= before <= "ӿ") or span[1] not in _CLOSERS
        return not (before.isupper() and span[0].isupper() and span[1] in _CLOSERS)

    def _credible(self, text: str, at: int, span: str, decoded: str) -> bool:
        if self.wrong in ("cp866", "koi8_r") and not _BOX.search(span):
            return False  # their trail and three-byte lead characters are plain Cyrillic letters
        if not _PLAUSIBLE.fullmatch(decoded):
            # a second round of garbling gives C1 controls and the like; they come with several sequences
            return len(decoded) >= 2 and all(_PLAUSIBLE.fullmatch(c) or c < "\xa0" or c in byte_of("latin") for c in decoded)
        if len(decoded) > 1 or len(span) > 2:
            return self.wrong not in ("cp1250", "cp1253") or len(span) > 2 or len(decoded) > 2
        if self.wrong in SURE_LEADS:
            sure = SURE_LEADS[self.wrong]
            return sure is None or span[0] in sure
        before = text[at - 1 : at]
        if self.wrong == "latin":
            if before.isupper() and span[0].isupper() and span[1] in _CLOSERS:
                return False
            return span[0].isupper() or span[0] in "\xd7\xdf" and not before.islower()
        if self.wrong == "cp1251":
            return span[1] not in _CLOSERS and not ("Ѐ" <= before <= "ӿ")
        lone = {"cp1250": "ÂĂÄĹ", "cp1253": "ΒΓ"}[self.wrong]
        after = text[at + 2 : at + 3]
        inside = span[0] in "ĂΓ" and after.islower() and (before.isalpha() or span[1] == "\N{LEFT SINGLE QUOTATION MARK}")
        return inside or span[0] in lone and (span[1] not in _CLOSERS or span[0] == "\N{LATIN CAPITAL LETTER L WITH ACUTE}" and before.islower()) and not (span[1].isalpha() and span[1].isupper() and not before)


_BOX = re.compile("[─-■]")
_PLAUSIBLE = re.compile(f"[{PLAUSIBLE_TWO}{PLAUSIBLE_MORE}]+")
# What may follow a letter in real text: closing quotes, blanks and dashes.
_CLOSERS = "\xa0\xab\xbb‘’‚“”„–—…‹›•"


@lru_cache(maxsize=None)
def automata() -> tuple[SpanAutomaton, ...]:
    return tuple(SpanAutomaton.of(w) for w in WRONG_DECODERS)


# Double-byte encodings with their byte structure, and the bytes of their common characters.
DOUBLE_BYTE = {
    "gb18030": (rb"(?:[\xa1-\xfe][\xa1-\xfe])+", rb"[\xa3\xb0-\xd7]."),
    "euc_kr": (rb"(?:[\xa1-\xfe][\xa1-\xfe])+", rb"[\xb0-\xc8]."),
    "euc_jp": (rb"(?:[\xa1-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf])+", rb"[\xa4\xa5\xb0-\xcf]."),
    "shift_jis": (rb"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+", rb"(?:\x82[\x9f-\xf1]|\x83[\x40-\x96]|[\x88-\x9f].)"),
    "big5": (rb"(?:[\xa1-\xf9][\x40-\x7e\xa1-\xfe])+", rb"[\xa4-\xc6]."),
}
# Single-byte encodings that text may have been in, and the letters they're for.
SINGLE_BYTE = {
    "cp1251": "А-яЁё",
    "koi8_r": "А-яЁё",
    "cp866": "А-яЁё",
    "iso8859_5": "А-яЁё",
    "mac_cyrillic": "А-яЁё",
    "cp1253": "Ά-ώ",
    "cp1256": "،؛؟ء-\N{ARABIC SUKUN}پچگکیہںے",
    "tis_620": "ก-๛",
    "cp1250": "Ą-ž\xd3\xf3\xc0-\xff",
    "iso8859_2": "Ą-ž\xd3\xf3\xc0-\xff",
    "cp1252": "\xc0-\xd6\xd8-\xf6\xf8-\xff",
    "cp850": "\xc0-\xd6\xd8-\xf6\xf8-\xff",
    "cp437": "\xc0-\xd6\xd8-\xf6\xf8-\xff",
    "mac_roman": "\xc0-\xd6\xd8-\xf6\xf8-\xff",
}

_LETTERS = {k: re.compile(f"[{v}]") for k, v in SINGLE_BYTE.items()}

_LOW = "a-z\xdf-\xf6\xf8-\xff"
# Shapes that no real text has. Each is tried only if the text holds a character that it needs.
_SHAPES: dict[str, re.Pattern[str]] = {
    "lost": re.compile("[\N{REPLACEMENT CHARACTER}\x80-\x84\x86-\x9f]"),
    "graphic": re.compile(r"[^\W\d_][─-■]|[─-■][^\W\d_]|[─-▓]{2}[\xa0-\xff]|ΓÇ|α[╕╣]"),
    "letters": re.compile("[\xc0-\xd6\xd8-\xf6\xf8-\xff]{4,}|(?:[\xa1-\xff][!-~]?){6,}"),
    "inner_capital": re.compile(f"(?<!\\w)[A-Z][\xc0-\xcf\xd1-\xd6\xd9-\xdd][a-z]{{2}}|(?<!\\w)\xd0[a-z]|[\xc0-\xd6\xd8-\xde]{{2}}[A-Z][a-z]|[A-Za-z][ŽœŠ][‘’“”]|[A-Z][ŸŽ][a-z]|(?<!\\w)œ[bcdfgjklmnpqtvwxyz]|[{_LOW}][†‡][\xc0-\xde]|[{_LOW}][\xc0-\xd6\xd8-\xdeŠŽŸŒ][{_LOW}]"),
    "inner_sign": re.compile(f"[A-Z][\xa7\xa8\xb1\xb3\xb6\xb8\xf7€][a-z\xe0-\xff]|(?<!\\w)[\xa4-\xa6][a-z]{{2}}|[{_LOW}][\xa1-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7ƒˆ˜ˇ˘˙˚˛˝‚„†-•‰‹™€∂∆∏∑√∞∫≈≠≡≤≥⌐⌠⌡ⁿ◊ﬁﬂ]+[a-z]"),
    "alphabets": re.compile("[A-Za-z][Гб-дж-нпт-фц-яα-θπ-φΘΣΦΩ]|[Гб-дж-нпт-фц-яΘΣΦΩ][a-z]"),
    "inverted": re.compile("[а-яё][А-ЯЁ]{3}"),
    "odd_cyrillic": re.compile("[А-я][ЂЃЈ-Џђѓј-џҐ][А-я]|[ЂЃЉ-ЌЏђѓљ-ќџЎҐ]{2}|[ЂЃЇЉ-ЌЏЎҐ][\xa6-\xbf‘-…]|[\xa6-\xbf‘-…][ЂЃЇЉ-ЌЏЎҐ]"),
    "kana": re.compile("(?:[‚ƒ][!-\xff–-™Œ-ƒ]){3}|[｡-ﾟ]{2}[^｡-ﾟ\\s\N{IDEOGRAPHIC SPACE}-ヿ]"),
}
_NEEDS: dict[str, re.Pattern[str]] = {
    "lost": re.compile("[\N{REPLACEMENT CHARACTER}\x80-\x9f]"),
    "graphic": re.compile("[─-■Γα]"),
    "letters": re.compile("[\xa1-\xff]"),
    "inner_capital": re.compile("[\xc0-\xdeŒ-Ž]"),
    "inner_sign": re.compile("[\xa1-\xbf\xd7\xf7ƒˆ-˝‚-⌢◊ﬁﬂ]"),
    "alphabets": re.compile("[ΐ-ӿ]"),
    "inverted": re.compile("[А-Я]"),
    "odd_cyrillic": re.compile("[Ђ-Џђ-Ґ]"),
    "kana": re.compile("[ƒ｡-ﾟ]"),
}


def _outside_ascii(text: str) -> str:
    return "".join(sorted(c for c in set(text) if c > "\x7f"))


def utf8_spans(text: str, held: str | None = None, all_spans: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The wrong decoder whose credible UTF-8 spans cover most of a text, and those spans; with ``all_spans`` its likely ones too."""
    have = set(_outside_ascii(text) if held is None else held)
    best: tuple[int, str | None, list[tuple[int, int, str]]] = (0, None, [])
    for a in automata():
        if have.isdisjoint(a.leads) or have.isdisjoint(a.trails):
            continue
        spans = list(a.spans(text))
        if spans and all_spans:
            spans = list(a.spans(text, sure=True))
        size = sum(e - s for s, e, _ in spans)
        if size > best[0]:
            best = (size, a.wrong, spans)
    return best[1], best[2]


def shapes(text: str, held: str | None = None) -> list[str]:
    """Names of the impossible shapes in a text."""
    have = _outside_ascii(text) if held is None else held
    return [k for k, need in _NEEDS.items() if need.search(have) and _SHAPES[k].search(text)]


#: ASCII characters beside another one that any rule looks at, at most.
REACH = 3
_PLAIN_RUN = re.compile(r"([\x00-\x7f]{3})[\x00-\x7f]{2,}(?=[\x00-\x7f]{3})")


def _condensed(text: str) -> str:
    """A text with its ASCII runs cut to the characters at either end that rules can reach, which changes no finding."""
    return _PLAIN_RUN.sub(r"\1\n", text)


def reason(text: str | None) -> tuple[str, str] | None:
    """(way, why) a text counts as garbled: ``span`` for a span of UTF-8 bytes, ``lost`` for characters that stand for lost ones,
    ``shape`` for impossible shapes that a pair of encodings explains. None for a sound text; null, empty and ASCII ones are sound."""
    if not text or text.isascii():
        return None
    held, near = _outside_ascii(text), _condensed(text)
    wrong, spans = utf8_spans(near, held)
    if spans:
        return "span", f"utf-8 read as {wrong}"
    found = shapes(near, held)
    if "lost" in found:
        return "lost", ", ".join(found)
    pair = confirmed_pair(text) if found else None
    return ("shape", f"{pair[1]} read as {pair[0]}") if pair else None


def diagnose(text: str | None) -> str | None:
    """Why a text counts as garbled, or None."""
    why = reason(text)
    return why[1] if why else None


_WORDS = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*(?:[ \xa0]+[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*)*")


def _to_bytes(text: str, wrong: str) -> bytes | None:
    m = byte_of(wrong)
    try:
        return bytes(b if (b := ord(c)) < 0x80 else m[c] for c in text)
    except KeyError:
        return None


def _readings(part: str) -> Iterator[tuple[tuple[str, str], str, float]]:
    """((wrong, true), reading, score) of a stretch for each pair of encodings that can read it."""
    high = sum(c > "\x7f" for c in part)
    for wrong in WRONG_DECODERS:
        raw = _to_bytes(part, wrong)
        if raw is None:
            continue
        for true, letters in _LETTERS.items():
            if true == wrong or (wrong == "latin" and true == "cp1252"):
                continue
            try:
                d = raw.decode(true)
            except UnicodeDecodeError:
                continue
            yield (wrong, true), d, len(letters.findall(d)) / high - len(shapes(d)) + 0.5 * _frequent(d, true)
        for true, (form, common) in DOUBLE_BYTE.items():
            runs = re.findall(form, raw)
            covered = sum(map(len, runs))
            if covered < 4 or covered < 0.9 * sum(b > 0x7F for b in raw):
                continue
            try:
                d = raw.decode(true)
            except UnicodeDecodeError:
                continue
            pairs = b"".join(runs)
            kana = sum("\N{HIRAGANA LETTER SMALL A}" <= c <= "\N{HIRAGANA LETTER N}" for c in d) > 0.2 * len(d)
            # the common characters of Korean lie within those of Chinese, so that equal hits speak for Korean
            weight = 2.4 + 0.3 * (true == "euc_kr") + 0.6 * kana
            yield (wrong, true), d, weight * len(re.findall(common, pairs)) / max(1, len(pairs)) - len(shapes(d))


_SENTENCE = re.compile(r"(?<=[.!?…»])[ \xa0]+")
_NARROW = re.compile(r"[\x00-\xff]+")


def _bad_parts(text: str) -> list[str]:
    """The stretches with impossible shapes: sentences, and within those that hold letters of other scripts too, what could be single bytes."""
    out = []
    for m in _WORDS.finditer(text):
        if not shapes(m[0]):
            continue
        for part in _SENTENCE.split(m[0]):
            found = shapes(part)
            if found and "\N{REPLACEMENT CHARACTER}" not in part:
                out += _NARROW.findall(part) if "letters" in found else [part]
    return [p for p in out if shapes(p)]


def _best_pair(bad: list[str]) -> tuple[str, str] | None:
    """The pair of encodings that explains the stretches best."""
    votes: dict[tuple[str, str], float] = {}
    for part in bad:
        for pair, _, score in _readings(part):
            votes[pair] = votes.get(pair, 0.0) + score * len(part)
    best = max(votes, key=lambda k: votes[k], default=None)
    return None if best is None or votes[best] <= 0 else best


#: Letters, or letters within words of at least WORD letters, that a reading must restore, and the share of them that the script uses most.
OWN_SCRIPT, ACCENTED, WORD, SHARE = 6, 2, 4, 0.5
_FOREIGN = re.compile("[─-■Ͱ-ӿ]|[a-z]{3}[\xa2\xa3\xa5\xa7\xa8\xac\xaf\xb3\xb6\xb8\xb9\xbfˆ˜†‡][a-z]")
_READ_WORD = re.compile(r"[^\W\d_]+")


def confirmed_pair(text: str) -> tuple[str, str] | None:
    """The pair of encodings that a text's impossible shapes come from, or None where no reading is better text than the shapes are.

    A reading is free of such shapes. In scripts of their own it restores at
    least six letters, half of them the most frequent; among Latin letters at
    least two accented ones in words of four letters or more, half of them the
    most frequent, or one frequent letter in a word of five; in double-byte
    encodings at least three characters, most of them common.
    """
    bad = _bad_parts(text)
    pair = _best_pair(bad)
    if pair is None:
        return None
    wrong, true = pair
    letters: list[str] = []
    words: list[tuple[int, str, str]] = []
    pairs = common = 0
    for part in bad:
        raw = _to_bytes(part, wrong)
        try:
            read = raw.decode(true) if raw is not None else None
        except UnicodeDecodeError:
            read = None
        if read is None or shapes(read):
            continue
        if true in DOUBLE_BYTE:
            form, usual = DOUBLE_BYTE[true]
            runs = b"".join(re.findall(form, raw))
            pairs += len(runs) // 2
            common += len(re.findall(usual, runs))
            continue
        letters += [n for o, n in zip(part, read, strict=True) if o > "\x7f" and n.isalpha()]
        for m in _READ_WORD.finditer(read):
            words += [(len(m[0]), part[m.start() : m.end()], n) for o, n in zip(part[m.start() : m.end()], m[0], strict=True) if o > "\x7f" and len(m[0]) >= WORD]
    if true in DOUBLE_BYTE:
        return pair if pairs >= 3 and common >= 0.6 * pairs else None
    usual_letters = _FREQUENT[_script(true)]
    if _script(true) != "latin":
        return pair if len(letters) >= OWN_SCRIPT and sum(n.lower() in usual_letters for n in letters) >= SHARE * len(letters) else None
    frequent = [size for size, _, n in words if n.lower() in usual_letters]
    if len(words) >= ACCENTED:
        return pair if len(frequent) >= SHARE * len(words) else None
    return pair if frequent and frequent[0] > WORD and _FOREIGN.search(words[0][1]) else None


def _legacy(text: str) -> str:
    """A text with impossible shapes, its garbled stretches read by the one pair of encodings that explains them best."""
    bad = _bad_parts(text)
    best = _best_pair(bad)
    if best is None:
        return text
    wrong, true = best
    marks = {c for part in bad for c in part if c > "\x7f"}

    def read(part: str) -> str:
        raw = None if marks.isdisjoint(part) else _to_bytes(part, wrong)
        if raw is None:
            return part
        try:
            d = raw.decode(true)
        except UnicodeDecodeError:
            return part
        return d if len(shapes(d)) <= len(shapes(part)) else part

    def read_stretch(m: re.Match[str]) -> str:
        whole = read(m[0])
        if whole != m[0] or not shapes(whole):
            return whole
        out, at = [], 0
        for part in bad:
            k = m[0].find(part, at)
            if k >= 0:
                out += [m[0][at:k], read(part)]
                at = k + len(part)
        return "".join([*out, m[0][at:]])

    return _WORDS.sub(read_stretch, text)


# The most frequent small letters of the scripts that several encodings share.
_FREQUENT = {
    "cyrillic": "оеаинтсрвл",
    "latin": "\xe9\xe4\xf6\xfc\xdf\xe8\xe0\xe1\xed\xf3\xf1\xe7\xe3\xeałęążś",
    "greek": "αοιετσνηυρ",
    "arabic": "ايلمونرتبة",
    "thai": "านรอกเงมยลวดทสต",
}
_SCRIPTS = {"cp1251": "cyrillic", "koi8_r": "cyrillic", "cp866": "cyrillic", "iso8859_5": "cyrillic", "mac_cyrillic": "cyrillic", "cp1253": "greek", "cp1256": "arabic", "tis_620": "thai"}


def _script(true: str) -> str:
    return _SCRIPTS.get(true, "latin")


def _frequent(text: str, true: str) -> float:
    script = _script(true)
    if script in ("arabic", "thai") or script == "greek" and re.search("[a-z]", text):
        return 0.0
    usual = _FREQUENT[script]
    high = [c for c in text if c > "\x7f" and c.isalpha()]
    return sum(c in usual for c in high) / max(1, len(high))


def repair(text: str | None) -> str | None:
    """What a text was meant to be; the text itself where nothing is garbled or nothing can be restored."""
    if not text or text.isascii():
        return text
    while True:  # a span is longer than what it decodes to, so that each round shortens the text
        wrong, spans = utf8_spans(text, all_spans=True)
        if not spans:
            break
        covered = sum(e - b for b, e, _ in spans) / sum(c > "\x7f" for c in text)
        if covered < (0.2 if wrong == "latin" else 0.6) and "letters" in shapes(text):
            break  # chance spans within text of another encoding
        out, at = [], 0
        for s, e, d in spans:
            out += [text[at:s], d]
            at = e
        text = "".join([*out, text[at:]])
    found = shapes(text)
    return _legacy(text) if "lost" in found or found and confirmed_pair(text) else text


def _run(df: DataFrame, key: str, text: str, with_text: bool) -> DataFrame:
    kind = dict(df.dtypes)[key]
    names = [key, "reason"] + ["repaired", "restored"] * with_text
    schema = f"`{key}` {kind}, reason string" + ", repaired string, restored boolean" * with_text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, why, new, ok = [], [], [], []
            for k, t in enumerate(batch.column(1)):
                t = t.as_py()
                reason = diagnose(t)
                if reason is None:
                    continue
                keep.append(k)
                why.append(reason)
                if with_text:
                    r = repair(t)
                    new.append(r)
                    ok.append(diagnose(r) is None)
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(why, pa.string())]
            if with_text:
                columns += [pa.array(new, pa.string()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    suspects = df.select(key, text).filter(F.col(text).rlike(r"[^\x00-\x7f]"))  # ASCII text can't be garbled; it stays in the JVM
    return suspects.mapInArrow(scan, schema)


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reason) of each row whose text holds characters that come from decoding with a wrong encoding.

    Null, empty and ASCII texts are sound. Repeated rows stay repeated, further
    columns are left out, whatever their names.
    """
    return _run(df, key, text, False)


def repair_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As find_garbled with the text ``repaired`` as far as possible; ``restored`` tells whether nothing garbled is left."""
    return _run(df, key, text, True)
