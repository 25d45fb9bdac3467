"""Texts of a block as arrays: code points, words, quotations and the gaps between words with what stands around them.

A block joins texts by empty lines, so that every step runs once over an array
instead of once for each character; only marks of quotation and lines that may
begin with a list mark are looked at one by one. All steps are linear in the
text, and none looks through a window.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cached_property, lru_cache

import numpy as np
import regex

from textlode.core.jstext import WS_CHARS

# Characters that end sentences, close them, and open them.
STOPS = ".!?…。！？।॥۔؟።፧．｡\N{MYANMAR SIGN SECTION}\N{KHMER SIGN KHAN}\N{TIBETAN MARK SHAD}\N{ARMENIAN FULL STOP}"
WIDE_STOPS = "。！？｡"
SURE_STOPS = "!?？！।॥۔؟።፧\N{MYANMAR SIGN SECTION}\N{KHMER SIGN KHAN}\N{ARMENIAN FULL STOP}"
CLOSERS = "\"'”’»›)]}」』》）】］〉“‘"
OPENERS = "\"'“‘«‹„‚([{「『《（【［〈¿¡"
DASHES = "–—―-"
QUOTE_PAIRS = {"“": "”", "„": "“”", "‚": "‘’", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］", "〈": "〉", "‘": "’"}
BRACKETS = "([{（【［"
# Scripts that put no blank between words.
DENSE_RANGES = ((0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

SPACE, LINE, PARAGRAPH, NOTHING = range(4)
BLANK, BREAK, LOWER, UPPER, CASELESS, MARK, DIGIT, SIGN, DENSE, HIDDEN = range(10)
MIXED = 10
#: Words of a line that are told apart; longer lines count as of so many.
LENGTHS = 64

_MARKER = regex.compile(r"(?:[-*•·▪‣◦○●■□–—](?:[ \t\xa0]+)(?=[\p{Lu}\p{Lo}\p{N}])|[-*•·▪‣◦○●■□][ \t\xa0]+|\p{N}{1,2}[.)](?:[ \t\xa0]+)|\p{L}\)[ \t\xa0]+|\([\p{L}\p{N}]{1,3}\)[ \t\xa0]+)")
_SENTENCE_WORD = regex.compile(r"[\p{Lu}\p{Lo}][\p{Ll}\p{Lo}\p{M}]|[\p{Lu}\p{Lo}][’ ]|[" + regex.escape(OPENERS) + "—]")
_UNIT_LETTER = regex.compile(r"\p{N}[ \xa0]?\p{Ll}")

_GROUP = np.array([0, 0, 1, 1, 1, 1, 2, 3, 4, 0], np.uint8)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


@lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, small letter) of each code point."""
    kind = np.full(0x110000, SIGN, np.uint8)
    small = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            kind[c] = LOWER if ch.islower() else UPPER if ch.isupper() else CASELESS
            low = ch.lower()
            if len(low) == 1:
                small[c] = ord(low)
        elif cat[0] == "M":
            kind[c] = MARK
        elif cat[0] == "N":
            kind[c] = DIGIT
        elif cat == "Cf":
            kind[c] = HIDDEN
    kind[0x20000:0x40000] = CASELESS
    kind[0xE0000:0xE1000] = HIDDEN
    kind[0xFE0F] = HIDDEN
    for a, b in DENSE_RANGES:
        part = kind[a : b + 1]
        part[part == CASELESS] = DENSE
    kind[[ord(c) for c in WS_CHARS]] = BLANK
    kind[[ord("\n"), ord("\r")]] = BREAK
    return kind, small


@lru_cache(maxsize=None)
def among(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(a: np.ndarray | int, b: np.ndarray | int = 0) -> np.ndarray:
    """One number for an ordered pair of them, its three low bits free."""
    with np.errstate(over="ignore"):
        x = np.asarray(a, np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + np.asarray(b, np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(29))) & ~np.uint64(7)


def key(word: str) -> int:
    """The number by which a word is known; 61 bits, so that two words of a corpus practically never share one."""
    small = _tables()[1]
    total = sum((int(small[ord(c)]) + 1) * pow(_ODD, k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)
    return int(mix(np.uint64(total)))


NUMBER, DOTTED, DEGREE = (key(c) for c in "\x00\x01\x02")


def stop_key(word: str, stop: str = ".") -> int:
    """The number of a word with the stop behind it."""
    return int(mix(np.uint64(key(word)), ord(stop)))


class Block:
    """Texts with their words (``ts``, ``te``: start and end among ``cp``) and gaps (``gap``: the word before each).

    A sign stands before the first text, so that each text begins behind the end
    of another and comes out the same in any block.
    """

    def __init__(self, texts: Sequence[str]):
        kind, small = _tables()
        joined = "\n\n".join(["\x03", *texts]) + "\n\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
        self.n_raw = len(raw)
        lengths = np.array([3, *(len(t) + 2 for t in texts)], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(lengths)])
        raw_kind = self._raw_kind = kind[raw]
        if (raw_kind == HIDDEN).any():
            self.pos = np.flatnonzero(raw_kind != HIDDEN)
            self.cp = raw[self.pos]
            self.text = self.cp.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        else:
            self.pos, self.cp, self.text = None, raw, joined
        self.kind = c = kind[self.cp]
        n = len(c)
        g = _GROUP.take(c)
        before = np.empty_like(g)
        before[:1], before[1:] = 0, g[:-1]
        blank = c <= BREAK
        begin = ~blank & ((g != before) | (c == SIGN) | (c == DENSE))
        begin &= ~((c == MARK) & ((before == 4) | (before == 2)))
        last = ~blank
        last[:-1] &= begin[1:] | blank[1:]
        self.ts, self.te = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.n = len(self.ts)
        with np.errstate(over="ignore"):
            up, down = _powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((small[self.cp] + np.uint64(1)) * up, out=sums[1:])
            self.h = mix((sums[self.te] - sums[self.ts]) * down[self.ts]) if self.n else np.zeros(0, np.uint64)
        self.head = self.cp[self.ts]  # first character of each word
        tc = c[self.ts]
        self.tc = np.where(tc == MARK, CASELESS, tc)
        if self.n:
            within = np.flatnonzero((c[1:] == UPPER) & ((c[:-1] == LOWER) | (c[:-1] == MARK))) + 1  # a capital behind small letters
            word = np.searchsorted(self.ts, within, "right") - 1
            self.tc[word[self.tc[word] == LOWER]] = MIXED
        self.wordy = self.tc != SIGN
        new_line = np.flatnonzero(c == BREAK)
        new_line = new_line[~((self.cp[new_line] == 10) & (new_line > 0) & (self.cp[new_line - 1] == 13))]
        # what lies behind each word: the last one's text ends there
        behind = np.searchsorted(self.te, new_line, "right") - 1
        broken = np.bincount(behind[behind >= 0], minlength=self.n)
        self.kinds = np.where(np.append(self.ts[1:], n) == self.te, NOTHING, SPACE)
        self.kinds[broken == 1], self.kinds[broken > 1] = LINE, PARAGRAPH
        if self.n:
            self.kinds[-1] = PARAGRAPH
        self._stops()

    # words

    def is_sign(self, chars: str) -> np.ndarray:
        return among(chars)[self.head] & (self.tc == SIGN)

    @cached_property
    def left(self) -> np.ndarray:
        """What each word counts as before a gap: numbers by the word before them, dotted letters and degrees as one."""
        h, tc, n = self.h, self.tc, self.n
        out = h.copy()
        dot = self.is_sign(".")
        real = np.where(dot, -1, np.arange(n))
        shifted = np.concatenate([[-1], np.maximum.accumulate(real)[:-1]]) if n else real
        number = np.flatnonzero(tc == DIGIT)
        by = shifted[number]
        paragraph = np.zeros(n + 1, np.int64)
        ends = np.flatnonzero(self.kinds == PARAGRAPH)
        paragraph[ends + 1] = ends + 1
        ok = (by >= np.maximum.accumulate(paragraph)[number]) & (tc[by] != DIGIT)
        out[number] = np.where(ok, mix(NUMBER, h[by]), NUMBER)
        one = (self.te - self.ts == 1) & (tc >= LOWER) & (tc <= CASELESS)
        i = np.flatnonzero(one)
        i = i[i >= 2]
        i = i[dot[i - 1] & (self.te[i - 1] == self.ts[i]) & one[i - 2] & (self.te[i - 2] == self.ts[i - 1])]
        out[i] = mix(mix(DOTTED, h[i - 2]), h[i])
        i = np.flatnonzero(one & among("CF")[self.head])
        i = i[i >= 1]
        i = i[(self.head[i - 1] == 0xB0) & (self.te[i - 1] == self.ts[i])]
        out[i] = mix(DEGREE, h[i])
        return out

    @cached_property
    def is_short(self) -> np.ndarray:
        return self.te - self.ts <= 3

    # gaps

    def _stops(self) -> None:
        n = self.n
        stop = self.is_sign(STOPS)
        odd = np.flatnonzero(self.is_sign(";\N{GREEK QUESTION MARK}"))
        odd = odd[odd > 0]
        odd = odd[self.te[odd - 1] == self.ts[odd]]
        greek = self.cp[self.ts[odd] - 1]
        stop[odd[((greek >= 0x370) & (greek < 0x400)) | ((greek >= 0x1F00) & (greek < 0x2000))]] = True
        touching = np.concatenate([self.te[:-1] == self.ts[1:], [False]]) if n else np.zeros(0, bool)
        run_on = stop & np.concatenate([stop[1:], [False]]) & touching
        self.first_stop = np.flatnonzero(stop & ~np.concatenate([[False], run_on[:-1]])) if n else np.zeros(0, np.int64)
        self.last_stop = np.flatnonzero(stop & ~run_on)
        closer, outer = self.is_sign(CLOSERS), self.is_sign("»›")
        end = self.last_stop.copy()
        moving = np.arange(len(end))
        while len(moving):
            e = end[moving]
            moving, e = moving[e + 1 < n], e[e + 1 < n]
            ok = (closer[e + 1] & touching[e]) | (outer[e + 1] & (self.ts[e + 1] == self.te[e] + 1) & (self.kinds[e] == SPACE))
            moving = moving[ok]
            end[moving] += 1
        at_stop = np.full(n, -1, np.int64)
        at_stop[end] = np.arange(len(end))
        # blanks between a stop and what closes it are no gaps
        within = np.zeros(n + 1, np.int64)
        np.add.at(within, self.last_stop, 1)
        np.add.at(within, end, -1)
        within = np.cumsum(within)[:n] > 0
        dense = (self.tc == DENSE) & np.concatenate([self.tc[1:] == DENSE, [False]]) & touching if n else np.zeros(0, bool)
        here = (((self.kinds != NOTHING) & ~within) | dense | (at_stop >= 0)).copy()
        if n:
            here[-1] = False
        self.gap = np.flatnonzero(here)
        self.stop = at_stop[self.gap]  # which run of stops ends there, -1 for none
        self.gap_kind = self.kinds[self.gap]

    def ends_text(self, gap: np.ndarray) -> np.ndarray:
        """Whether a text ends behind each gap."""
        after, start = np.append(self.ts, len(self.cp))[gap + 1], self.te[gap]
        if self.pos is not None:
            raw = np.append(self.pos, self.n_raw)
            after, start = raw[after], raw[start]
        return np.searchsorted(self.text_at, after, "right") > np.searchsorted(self.text_at, start - 1, "right")

    @cached_property
    def _firm(self) -> np.ndarray:
        firm = ~(among(OPENERS + DASHES)[self.head] & (self.tc == SIGN))
        return np.minimum.accumulate(np.append(np.where(firm, np.arange(self.n), self.n), self.n)[::-1])[::-1]

    def right(self, gap: np.ndarray) -> np.ndarray:
        """The word behind each gap, opening marks and dashes skipped; the number of words where there's none."""
        return self._firm[gap + 1]

    def right_kind(self, right: np.ndarray) -> np.ndarray:
        k = np.append(self.tc, SIGN)[right]
        return np.where(k == DENSE, CASELESS, k)

    @cached_property
    def line_ends(self) -> np.ndarray:
        return np.flatnonzero((self.kinds == LINE) | (self.kinds == PARAGRAPH))

    @cached_property
    def line_start(self) -> np.ndarray:
        """The first word of each word's line."""
        out = np.zeros(self.n + 1, np.int64)
        out[self.line_ends + 1] = self.line_ends + 1
        return np.maximum.accumulate(out)[: self.n]

    @cached_property
    def line_end(self) -> np.ndarray:
        """The word behind the last one of each word's line."""
        out = np.full(self.n, self.n, np.int64)
        out[self.line_ends] = self.line_ends + 1
        return np.minimum.accumulate(out[::-1])[::-1]

    @cached_property
    def words_before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.wordy)])

    @cached_property
    def _widths(self) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(np.where(self.tc == DENSE, 0.5, self.wordy))])

    def line_words(self, gap: np.ndarray) -> np.ndarray:
        """Words of the line up to each gap, two characters of a script without blanks counting as one."""
        return np.minimum(self._widths[gap + 1] - self._widths[self.line_start[gap]], LENGTHS - 1).astype(np.int64)

    @cached_property
    def _smiles(self) -> np.ndarray:
        return np.flatnonzero(self.wordy & (self.head == ord("ツ")))

    def signs_only(self, word: np.ndarray) -> np.ndarray:
        """Whether no letter or number stands between a word and the end of its line (a lone smiling kana aside)."""
        word = np.minimum(word, self.n - 1)
        end = self.line_end[word]
        k = np.searchsorted(self._smiles, end) - np.searchsorted(self._smiles, word) if len(self._smiles) else 0
        return (self.words_before[end] - self.words_before[word] == k) & (k <= 1)

    @cached_property
    def quotations(self) -> np.ndarray:
        """Rows (first mark, last mark, is bracket, opens a unit), by words; none reaches across an empty line."""
        marks = "\"'" + "".join(QUOTE_PAIRS) + "".join(QUOTE_PAIRS.values())
        t = np.flatnonzero(self.is_sign(marks))
        if not len(t):
            return np.zeros((0, 4), np.int64)
        cp = np.concatenate([[10], self.cp, [10, 10]])
        before, after = cp[self.ts[t]], cp[self.te[t] + 1]
        kind = _tables()[0]
        kb, ka = kind[before], kind[after]
        letter_b, letter_a = (kb >= LOWER) & (kb <= DIGIT) | (kb == DENSE), (ka >= LOWER) & (ka <= DIGIT) | (ka == DENSE)
        ch = self.head[t]
        apostrophe = ((ch == 0x27) | (ch == 0x2019) & (kb != DIGIT) & (ka != DIGIT)) & letter_b & letter_a
        paragraphs = np.flatnonzero(self.kinds == PARAGRAPH)
        keep = ~apostrophe
        t, before, kb, letter_a, ch = t[keep], before[keep], kb[keep], letter_a[keep], ch[keep]
        ka = ka[keep]
        section = np.searchsorted(paragraphs, t)
        blank_b = kb <= BREAK
        straight = (ch == 0x22) | (ch == 0x27)
        may_open = blank_b | among(OPENERS + "—–-/")[before]
        after_stop = among(STOPS)[before] & (ch == 0x22)
        inner = ka > BREAK
        gap = self.kinds[np.maximum(t - 1, 0)]
        last = np.where(t > 0, self.cp[self.te[np.maximum(t - 1, 0)] - 1], 0)
        parted = (gap == LINE) | (gap == PARAGRAPH) | (t == 0)
        opens = among(STOPS + CLOSERS)[last] | (parted & ~among(",:;")[last]) | (gap == PARAGRAPH) | (t == 0)
        # a mark that only opens, with one that closes it right behind among the marks, is a pair whatever stands around it
        low = np.isin(section, section[among("„‚")[ch]])
        sure_open = among("([{「『《（【［〈")[ch] | among("“‘")[ch] & ~low
        closer = np.zeros(0x110000, np.uint32)
        for o, c in QUOTE_PAIRS.items():
            closer[ord(o)] = ord(c[0])
        pairs = np.flatnonzero(sure_open[:-1] & (closer[ch[:-1]] == ch[1:]) & (section[:-1] == section[1:]))
        quick = np.stack([t[pairs], t[pairs + 1], among(BRACKETS)[ch[pairs]], opens[pairs]], 1).astype(np.int64)
        left = np.ones(len(t), bool)
        left[pairs] = left[pairs + 1] = False
        t, ch, section, straight, may_open, after_stop, inner, blank_b, letter_a, opens = (x[left] for x in (t, ch, section, straight, may_open, after_stop, inner, blank_b, letter_a, opens))
        slow = self._pair(t.tolist(), ch.tolist(), section.tolist(), straight.tolist(), may_open.tolist(), after_stop.tolist(), inner.tolist(), blank_b.tolist(), letter_a.tolist(), opens.tolist())
        out = np.concatenate([quick, slow])
        return out[np.argsort(out[:, 0])]

    @staticmethod
    def _pair(words: list, chars: list, sections: list, straight: list, may_open: list, after_stop: list, inner: list, blank_before: list, letter_after: list, opens: list) -> np.ndarray:
        """Pairs the marks: each closing mark takes the nearest open one that it fits and drops those opened since."""
        openers_of: dict[int, list[int]] = {}
        for o, closing in QUOTE_PAIRS.items():
            for c in closing:
                openers_of.setdefault(ord(c), []).append(ord(o))
        for c in "\"'":
            openers_of[ord(c)] = [ord(c)]
        open_marks = {ord(o) for o in QUOTE_PAIRS}
        brackets = {ord(c) for c in BRACKETS}
        stack: list[int] = []  # open marks by their place in the lists
        places: dict[int, list[int]] = {}  # for each character, where in the stack it stands
        out: list[tuple[int, int, int, int]] = []
        now = -1

        def close(k: int, c: int) -> bool:
            depth = max((p[-1] for o in openers_of.get(c, ()) if (p := places.get(o))), default=-1)
            if depth < 0:
                return False
            k0 = stack[depth]
            while len(stack) > depth:
                places[chars[stack.pop()]].pop()
            out.append((words[k0], words[k], chars[k0] in brackets, opens[k0]))
            return True

        def push(k: int, c: int) -> None:
            places.setdefault(c, []).append(len(stack))
            stack.append(k)

        for k, c in enumerate(chars):
            if sections[k] != now:
                now = sections[k]
                stack.clear()
                places.clear()
            if straight[k]:
                inside = bool(places.get(c))
                opening = inner[k] and (may_open[k] or after_stop[k] and not inside)
                if c == 0x27 and not opening and (blank_before[k] or letter_after[k]):
                    continue
                if opening and not inside:
                    push(k, c)
                elif inside:
                    close(k, c)
            elif not close(k, c) and c in open_marks:
                push(k, c)
        out.sort()
        return np.array(out, np.int64).reshape(-1, 4)

    @cached_property
    def _reach(self) -> np.ndarray:
        out = np.full(self.n, -1, np.int64)
        q = self.quotations
        out[q[:, 0]] = q[:, 1]
        return np.maximum.accumulate(out)

    def inside(self, gap: np.ndarray) -> np.ndarray:
        """Whether each gap lies within a quotation or bracketed remark."""
        return self._reach[gap] > gap

    @cached_property
    def markers(self) -> np.ndarray:
        """Where the list mark at the head of a line ends, for the word that begins the line; -1 where there's none."""
        out = np.full(self.n + 1, -1, np.int64)
        if not self.n:
            return out
        starts = np.concatenate([[0], self.line_ends + 1])
        starts = starts[starts < self.n]
        ch, tc = self.head[starts], self.tc[starts]
        after = self.cp[np.minimum(self.te[starts], len(self.cp) - 1)]
        may = among("-*•·▪‣◦○●■□–—(")[ch] | (tc == DIGIT) | ((after == ord(")")) & (self.te[starts] - self.ts[starts] == 1))
        ends = set(map(ord, STOPS + CLOSERS))
        for t in starts[may].tolist():
            m = _MARKER.match(self.text, int(self.ts[t]))
            if not m:
                continue
            end = m.end()
            if m[0][0].isnumeric() and m[0][:2] not in ("1.", "1)") and t and self.kinds[t - 1] == LINE and int(self.cp[self.te[t - 1] - 1]) not in ends:
                # a number that a wrapped sentence goes on with is no mark: marks stand behind a stop or another mark
                above = int(self.line_start[t - 1])
                if out[above] < 0 and not _MARKER.match(self.text, int(self.ts[above])):
                    continue
            out[t] = end
        return out

    def unbroken(self, gap: np.ndarray) -> np.ndarray:
        """Length of the string of ASCII signs without a blank that reaches from each gap to the end of its line; 0 for none."""
        first = np.minimum(gap + 1, self.n - 1)
        blanks = self._blank_gaps
        stop = blanks[np.minimum(np.searchsorted(blanks, first), len(blanks) - 1)]
        whole = self.kinds[stop] != SPACE
        k = np.flatnonzero(whole)
        size = np.zeros(len(gap), np.int64)
        strange = np.concatenate([[0], np.cumsum(self.cp > 0x7F)]) if len(k) else np.zeros(1)
        a, b = self.ts[first[k]], self.te[stop[k]]
        size[k] = np.where(strange[b] == strange[a], b - a, 0)
        return size

    @cached_property
    def _addresses(self) -> np.ndarray:
        """Where addresses show, by words: a scheme, ``www.``, or an @ within a string."""
        n, h = self.n, self.h
        i = np.flatnonzero(((h == np.uint64(key("http"))) | (h == np.uint64(key("https"))) | (h == np.uint64(key("www")))))
        i = i[i + 1 < n]
        scheme = i[(self.head[i + 1] == ord(":")) | (self.head[i + 1] == ord("."))]
        at = np.flatnonzero(self.is_sign("@"))
        at = at[at > 0]
        return np.union1d(self.ts[scheme], self.ts[at[self.te[at - 1] == self.ts[at]]])

    def may_adjoin(self, run: int, gap: int) -> bool:
        """Whether a stop that no blank follows may end a sentence: a whole word before it, a capitalised or caseless word behind."""
        start, after = int(self.ts[self.first_stop[run]]), int(self.ts[gap + 1])
        word = int(self.first_stop[run]) - 1
        blanks = self._blank_gaps
        k = int(np.searchsorted(blanks, word))
        unbroken = int(self.ts[blanks[k - 1] + 1]) if k else 0
        a = self._addresses
        if len(a) and (j := int(np.searchsorted(a, start))) and a[j - 1] >= unbroken:
            return False
        stop = chr(int(self.cp[self.te[self.last_stop[run]] - 1]))
        if stop in "!?" or gap > self.last_stop[run]:
            return True
        if word < 0 or self.te[word] != start or not (self.wordy[word] or self.head[word] in (0xB0, 0x25)):
            return False
        behind = self.text[after : after + 2]
        initial = behind[:1].isupper() and behind[1:] == "." and self.te[word] - self.ts[word] > 1 + (self.tc[word] != LOWER)
        if not initial and not _SENTENCE_WORD.match(behind):
            return False
        if _UNIT_LETTER.fullmatch(self.text[max(0, start - 2) : start]) or _UNIT_LETTER.fullmatch(self.text[max(0, start - 3) : start]):
            return True
        begin = word
        while begin and self.te[begin - 1] == self.ts[begin] and (self.wordy[begin - 1] or self.head[begin - 1] in (0xB0, 0x25)) and self.te[word] - self.ts[begin] < 3:
            begin -= 1
        w = self.text[int(self.ts[begin]) : start]
        dotted = word >= 2 and self.te[word] - self.ts[word] == 1 and self.head[word - 1] == 0x2E and self.te[word - 1] == self.ts[word] and self.wordy[word - 2] and self.te[word - 2] == self.ts[word - 1]
        return len(w) > 1 and not (w[-1].isupper() and len(w) <= 2 and w[0] != "°") or w[-1] == "%" or bool(dotted and self.wordy[word])

    @cached_property
    def _blank_gaps(self) -> np.ndarray:
        return np.flatnonzero(self.kinds != NOTHING)

    # results

    @cached_property
    def solid(self) -> np.ndarray:
        """Where characters stand that aren't white space, hidden signs too."""
        return np.flatnonzero(self._raw_kind > BREAK)

    def spans(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the units that end behind the gaps of ``cut``, without white space at their ends."""
        if not len(self.solid):
            return (np.zeros(0, np.int64),) * 3
        after = self.te[self.gap[cut]]
        if self.pos is not None:
            after = np.append(self.pos, self.n_raw)[after]
        at = np.union1d(after, self.text_at[1:])
        k = np.searchsorted(self.solid, at)  # solid characters before each cut
        k0 = np.concatenate([[0], k[:-1]])
        some = k > k0
        a, b = self.solid[k0[some]], self.solid[k[some] - 1] + 1
        which = np.searchsorted(self.text_at, a, "right") - 1
        real = which > 0
        which, a, b = which[real], a[real], b[real]
        return which - 1, a - self.text_at[which], b - self.text_at[which]
