"""Sentence units of texts in any script by a hidden-event language model.

Between the words of a text stand hidden events: a boundary or none. Every gap
between two words (and between two characters of scripts without blanks) is
offered to the model, an n-gram model over words and events: P(event | word
before with its stop), P(what stands in the gap | event), P(word after |
boundary), and P(word after | word before, none) by classes of words, of which
every frequent word is one. Nobody has labelled the boundaries, so expectation
maximisation fits the tables to counts over all texts: a word like an
abbreviation is known by never standing before the end of a line, a heading by
nearly always standing there. A first pass counts stops, line ends and words; a
second runs forward-backward and counts the words around boundaries by their
posteriors; the last decides. Forms that tell nearly surely (an empty line, a
gap inside a quotation, a blank between Thai letters) are features with heavy
weights. Whether a paragraph uses stops at all is a hidden style, told by its
length and its stops, so that a gap without a stop can end a sentence only where
stops are lacking.

Chains are run over arrays (see sentence_text). The tables hold the words with
at least ``SHARE`` of all occurrences, so their size is bounded whatever the
corpus; other words count by their class. Counting aggregates inside each
partition, and no step shuffles text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.core.session import discard, materialize
from textlode.llm.sentence_text import (
    CASELESS, CLOSERS, DENSE, DIGIT, LENGTHS, LINE, LOWER, MIXED, NOTHING, NUMBER, OPENERS, PARAGRAPH, SIGN, SPACE, SURE_STOPS, UPPER, WIDE_STOPS, Block, among, mix, stop_key,
)

#: Share of all occurrences that a word, a stop's context or a line's last word needs for an entry of its own: at most 2^18 entries a table.
SHARE = 2.0**-18
#: Share of all words that makes a word a class of its own: at most 512 classes.
CLASS_SHARE = 2.0**-9
ROUNDS = 80
#: Code points in a block that arrays are made of; texts are never divided.
BLOCK_CHARS = 1 << 18
#: Log-odds of a feature that tells nearly surely, and of evidence beside it at most.
HEAVY, LIGHT = 16.0, 7.0
#: Factor of a boundary that leaves a unit of one word, by which neighbouring gaps depend on each other: a letter or number, another short word.
MARK_ALONE, SHORT = 0.02, 0.3
#: Prior odds of a paragraph that lacks stops, what each stop or line end does to them, and how often a stop is left out elsewhere.
BARE, KEPT, OMITTED = 0.002, 0.02, 1e-6
#: How often a text without stops leaves out capitals too.
UNCASED = 0.5

# Words that a stop follows without ending a sentence, by which the tables start.
ABBREVIATIONS = (
    "dr mr mrs ms prof st vs vol pp fig no sec para ver approx incl cf al e.g i.e etc jr sr hon rev gen col lt capt sgt "
    "bzw ca nr abs vgl usw evtl ggf inkl zzgl str hr fr dipl ing "
    "mme mlle m mm art av éd p ej sra srta dra d ee uu núm pág "
    "tj ul ok np itd godz im ks mgr inż "
    "г т е см стр тыс руб им ул д-р р гл "
    "κ π.χ δρ κα σελ bs ts ths pgs "
    "ड\N{DEVANAGARI VOWEL SIGN CANDRA O} श\N{DEVANAGARI SIGN VIRAMA}र\N{DEVANAGARI VOWEL SIGN II} د أ ص jan feb mar apr jun jul aug sep sept oct nov dec"
)


class Index:
    """Where keys stand in an array of distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.keys = keys
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        self.reach = 0
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that meet in a slot the last stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & int(self.mask)
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(20)) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._home(keys)
        out = self.slots[at]
        hit = (out >= 0) & (self.keys[out] == keys)
        left = np.flatnonzero(~hit & (out >= 0))
        out = np.where(hit, out, -1)
        for _ in range(self.reach - 1):
            if not len(left):
                break
            at = (at[left] + 1) & int(self.mask) if len(at) == len(keys) else (at + 1) & int(self.mask)
            found = self.slots[at]
            hit = (found >= 0) & (self.keys[found] == keys[left])
            out[left[hit]] = found[hit]
            on = ~hit & (found >= 0)
            left, at = left[on], at[on]
        return out.astype(np.int64)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def _abbreviation_keys() -> np.ndarray:
    from textlode.llm.sentence_text import DOTTED, key

    out = []
    for a in ABBREVIATIONS.split():
        if len(a) == 3 and a[1] == ".":
            dotted = int(mix(mix(np.uint64(DOTTED), np.uint64(key(a[0]))), np.uint64(key(a[2]))))
            out.append(int(mix(np.uint64(dotted), ord("."))))
        else:
            out.append(stop_key(a))
    return np.unique(np.array(out, np.uint64))


_OTHER_LOW, _OTHER_CAP, _OTHER_NUMBER, _OTHER_DENSE = range(4)


@dataclass
class Model:
    """Tables of log-odds by key.

    ``stop_*``: P(boundary | word and its stop). ``gap``: P(kind of gap | event).
    ``word_*``: the words with entries of their own, whose ``first`` is the
    log-odds of standing first after a stop. ``end_*``: P(boundary | last word of
    a line without a stop). ``length``: log-odds by the words of such a line. The
    rest is filled by the second pass: ``last`` P(boundary | word) and ``begin``
    (as ``first``, small letter and capital) for gaps without a stop; ``pair``,
    the log-ratio of P(class after | class before, none) to P(class after | none);
    and ``follow``, the ratio of the former behind a boundary to elsewhere.
    """

    stop_keys: np.ndarray
    stop_odds: np.ndarray
    gap: np.ndarray
    word_keys: np.ndarray
    first: np.ndarray  # [word, small | capital]
    end_keys: np.ndarray
    end_odds: np.ndarray
    length: np.ndarray
    span: np.ndarray = field(default_factory=lambda: np.array([12.0, 25.0]))  # words of a sentence in scripts with and without blanks
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # class of each word
    last: np.ndarray | None = None
    begin: np.ndarray | None = None
    pair: np.ndarray | None = None
    follow: np.ndarray | None = None
    _indexes: dict[str, Index] = field(default_factory=dict, repr=False)

    @classmethod
    def prior(cls) -> Model:
        none = np.zeros(0, np.uint64)
        abbreviations = _abbreviation_keys()
        gap = np.array([[0.98, 0.018, 0.001, 0.001], [0.6, 0.25, 0.1, 0.05]])
        length = np.where(np.arange(LENGTHS) <= 4, 1.0, np.where(np.arange(LENGTHS) <= 6, -1.0, -3.0))
        return cls(abbreviations, np.full(len(abbreviations), _logit(np.array(0.04))), gap, none, np.zeros((0, 2)), none, np.zeros(0), length)

    @classmethod
    def fit(cls, stops: np.ndarray, words: np.ndarray, ends: np.ndarray, lengths: np.ndarray, total: int) -> Model:
        """The tables of the first pass.

        Rows of counts: stops (key, kind of gap and whether its word is short, n), words (key, 0 or 1 small inside or first,
        2 or 3 capital inside or first, n), ends (key, 0 inside | 1 at a line's end, n), lengths (words of a line, event, n);
        ``total``: all occurrences of words.
        """
        m = cls.prior()
        prior = m
        if len(stops):
            # a small letter behind decides by itself; elsewhere the kind of gap tells, as no line ends behind an abbreviation
            keys, s = np.unique(np.concatenate([stops["key"], prior.stop_keys]), return_inverse=True)
            s = s[: len(stops)]
            k, n = stops["kind"] % 4, stops["n"].astype(float)
            base = np.where(np.isin(keys, prior.stop_keys), 0.04, 0.97)
            short = np.zeros(len(keys), bool)
            short[s[stops["kind"] >= 4]] = True
            weight = np.where(short, 4.0, 12.0)
            lam, gap = base.copy(), prior.gap.copy()
            total_n = np.bincount(s, n, len(keys))
            for _ in range(ROUNDS):
                p1, p0 = lam[s] * gap[1, k], (1 - lam[s]) * gap[0, k]
                q = n * p1 / (p1 + p0)
                lam = np.clip((np.bincount(s, q, len(keys)) + base * weight) / (total_n + weight), 1e-4, 1 - 1e-4)
                gap[1] = (np.bincount(k, q, 4) + 50 * prior.gap[1]) / (q.sum() + 50)
            m.stop_keys, m.stop_odds, m.gap = keys, _logit(lam), gap
        if len(words):
            keys, s = np.unique(words["key"], return_inverse=True)
            n = np.zeros((4, len(keys)))
            np.add.at(n, (words["kind"], s), words["n"])
            inner, first = n[[0, 2]], n[[1, 3]]
            odds = np.log((first + 0.5) / (first.sum() + len(keys) / 2)) - np.log((inner + 0.5) / (inner.sum() + len(keys) / 2))
            m.first = np.where(inner + first >= 2, np.clip(odds, -3, 3), 0.0).T
            m.word_keys = keys
            share = n.sum(0) / max(1, total)
            own = np.flatnonzero(share >= CLASS_SHARE)
            m.classes = np.full(len(keys), -1, np.int64)
            m.classes[own] = np.arange(len(own)) + 4
            sentences = max(1.0, first.sum())
            m.span = np.array([np.clip(total / sentences, 5, 40), 25.0])
        if len(ends):
            keys, s = np.unique(ends["key"], return_inverse=True)
            at_end, inner = (np.bincount(s, np.where(ends["kind"] == k, ends["n"], 0), len(keys)) for k in (1, 0))
            seen = at_end + inner
            # a wrapped line may end behind any word alike: at a small rate, that which nine in ten words keep to
            often = seen >= 20
            wrap = float(np.clip(np.quantile(at_end[often] / seen[often], 0.9), 0.01, 0.1)) if often.any() else 0.02
            p = np.clip(1 - (wrap * seen + 0.3) / (at_end + 0.5), 0.02, 0.995)
            m.end_keys, m.end_odds = keys, np.where(seen >= 3, _logit(p), 0.0)
        if len(lengths):
            n = np.zeros((2, LENGTHS))
            np.add.at(n, (lengths["kind"], (lengths["key"] // np.uint64(8)).astype(np.int64)), lengths["n"])
            weight = min(n[0].sum(), n[1].sum())
            odds = np.log((n[1] + 1) / (n[1].sum() + LENGTHS)) - np.log((n[0] + 1) / (n[0].sum() + LENGTHS))
            m.length = np.clip((weight * odds + 50 * prior.length) / (weight + 50), -4, 4)
        return m

    def index(self, table: str) -> Index:
        if table not in self._indexes:
            self._indexes[table] = Index(getattr(self, f"{table}_keys"))
        return self._indexes[table]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_indexes": {}}

    def refit(self, words: np.ndarray, pairs: np.ndarray, openings: np.ndarray) -> Model:
        """With the tables of the second pass. words: (place, kind 0 last | 1 not last | 2..5 inside and first, small and capital, n), places behind
        the last word being those of the classes of other words; pairs (class before, class after, n) without a boundary between, openings the same of the first two words behind one."""
        v = len(self.word_keys) + 4
        n = np.zeros((6, v))
        np.add.at(n, (words["kind"], words["key"].astype(np.int64)), words["n"])
        ended, going = n[0], n[1]
        rate = (ended.sum() + 1) / (ended.sum() + going.sum() + 2)
        self.last = _logit(np.clip((ended + 20 * rate) / (ended + going + 20), 1e-5, 1 - 1e-5))
        inner, first = n[[2, 4]], n[[3, 5]]
        loose = np.stack([UNCASED * first[1] + first[0], first[1]])  # small letters may stand for capitals
        f, i = (loose + 0.2) / (first.sum() + v / 5), (inner + 0.2) / (inner.sum() + v / 5)
        self.begin = np.clip(np.log(f) - np.log(i), -6, 6).T
        c = max([3, *self.classes.tolist()]) + 1
        t = np.zeros((c, c))
        np.add.at(t, (pairs["key"].astype(np.int64), pairs["kind"]), pairs["n"])
        row, col, total = t.sum(1, keepdims=True), t.sum(0, keepdims=True), max(1.0, t.sum())
        # the class bigram backs off to the class by itself, by the row's weight
        alone = (col + 1) / (total + c)
        usual = (t + 50 * alone) / (row + 50)
        self.pair = np.clip(np.log(usual) - np.log(alone), -5, 5)
        t = np.zeros((c, c))
        np.add.at(t, (openings["key"].astype(np.int64), openings["kind"]), openings["n"])
        self.follow = np.clip((t + 50 * usual) / (t.sum(1, keepdims=True) + 50) / usual, 0.6, 1.7)
        return self


# From a block to log-odds


@dataclass
class Scored:
    """Log-odds of a boundary at each gap of a block, and what the counts need."""

    odds: np.ndarray
    link: np.ndarray  # factor where this gap and the one before are boundaries
    after_first: np.ndarray  # factor where the one before is a boundary and this is none
    marked: Marked | None
    is_marked: np.ndarray
    after: np.ndarray  # the places of each word, as a word after a gap and before one
    before: np.ndarray


def _thai(cp: np.ndarray) -> np.ndarray:
    return ((cp >= 0x0E01) & (cp <= 0x0E3A)) | ((cp >= 0x0E40) & (cp <= 0x0E4E))


def _among(chars: str, cp: np.ndarray) -> np.ndarray:
    return among(chars)[cp]


@dataclass
class Marked:
    """The gaps that something marks (a stop, the end of a line, a Thai blank), by their place among all gaps, and what stands around them."""

    at: np.ndarray
    gap: np.ndarray
    right: np.ndarray
    right_kind: np.ndarray
    sure: np.ndarray  # 1, 0 or -1: what form tells nearly surely
    stop: np.ndarray  # masks of the three kinds
    line: np.ndarray
    thai: np.ndarray


def _features(b: Block, counting: bool = False) -> Marked:
    """For ``counting`` stops without a blank behind them, which aren't counted, aren't looked at."""
    kinds, last_cp = b.gap_kind, b.cp[b.te[b.gap] - 1]
    thai = (b.stop < 0) & ((kinds == SPACE) | (kinds == LINE)) & (last_cp >= 0x0E01) & (last_cp <= 0x0E4E)
    at = np.flatnonzero((b.stop >= 0) | (kinds == LINE) | (kinds == PARAGRAPH) | thai)
    gap, kind, run, last = b.gap[at], kinds[at], b.stop[at], last_cp[at]
    n = len(at)
    at_stop = run >= 0
    right = b.right(gap)
    right_kind = b.right_kind(right)
    nxt = b.head[np.minimum(gap + 1, b.n - 1)]
    inside = b.inside(gap)
    thai = thai[at] & _thai(last) & _thai(nxt) & ~inside
    line = ~at_stop & ((kind == LINE) | (kind == PARAGRAPH)) & ~thai
    marked = b.markers[np.minimum(gap + 1, b.n)] >= 0
    line_start = b.line_start[gap]
    only = b.signs_only(gap + 1)
    # lines that end without a stop
    before_last = np.concatenate([[0], b.cp])[b.te[gap] - 1]
    goes_on = (right_kind == LOWER) | _among(",;–—(", last) | _among(CLOSERS, last) & (before_last == ord(",")) | (last == ord(":")) & _among(OPENERS, nxt)
    alone = np.where(right_kind == SIGN, only, b.signs_only(line_start))
    told = np.where(marked, 1, np.where(goes_on, -1, np.where((b.markers[line_start] >= 0) | alone, 1, np.where(right_kind == SIGN, -1, 0))))
    sure = np.where(line, np.where(kind == PARAGRAPH, 1, np.where(inside, -1, told)), 0).astype(np.int8)
    # stops
    s = np.flatnonzero(at_stop)
    if len(s):
        run, g, k, r = run[s], gap[s], kind[s], right_kind[s]
        stop = b.cp[b.te[b.last_stop[run]] - 1]
        closed = g > b.last_stop[run]
        wide = _among(WIDE_STOPS, stop)
        nx, on, ins = nxt[s], only[s], inside[s]
        from_stop = _among(".!?…", nx)
        bare = k == NOTHING
        adjoin = np.zeros(len(s), bool)
        for j in [] if counting else np.flatnonzero(bare & ~wide & ((r == UPPER) | (r == CASELESS)) & ~ins & ~from_stop).tolist():
            adjoin[j] = b.may_adjoin(int(run[j]), int(g[j]))
        kana = (nx >= 0x3041) & (nx <= 0x309F)
        tight = np.where(from_stop | ins | (stop == ord("…")) & ~closed, -1, np.where(wide, np.where((closed & kana) | (r == SIGN) & ~on, -1, 1), np.where(adjoin, 0, -1)))
        in_marker = b.markers[line_start[s]] > b.ts[b.first_stop[run]]
        tells = np.where(in_marker, -1, np.where(k == PARAGRAPH, 1, np.where(ins, -1, np.where((k == LINE) & marked[s], 1, np.where(bare, tight, 0)))))
        opened = np.full(b.n + 1, -1, np.int64)
        q = b.quotations
        opened[q[:, 1]] = np.arange(len(q))
        own, look = np.full(len(s), -1, np.int64), g.copy()
        active = np.arange(len(s))
        while len(active):
            hit = opened[look[active]]
            own[active] = hit
            active = active[(hit < 0) & (look[active] - 1 > b.last_stop[run[active]])]
            look[active] -= 1
        qo = q[own] if len(q) else np.zeros((len(s), 4), np.int64)
        speaker = (own >= 0) & (qo[:, 0] < b.first_stop[run]) & (qo[:, 2] == 0) & (qo[:, 3] == 1) & (k != PARAGRAPH)
        cased = (r == UPPER) | (r == MIXED) | (r == CASELESS)
        names = speaker & (cased | (r == LOWER)) & ~_among(OPENERS + "—–-", nx)
        rest = np.where(
            names, -1,
            np.where(speaker, tells,
            np.where(((k == SPACE) | bare) & on, 1,
            np.where(((k == SPACE) | (k == LINE)) & (r == LOWER), -1,
            np.where(_among(SURE_STOPS, stop) & (cased | (r == DIGIT)) & ~bare, 1, tells)))),
        )
        tells = np.where(tells >= 0, rest, tells)
        # a line that would end there by itself, too
        below = (k == LINE) & (tells == 0) & ~ins & ~marked[s] & (r != SIGN) & b.signs_only(line_start[s])
        sure[s] = np.where(below, 1, tells)
    sure[thai] = 1
    return Marked(at, gap, right, right_kind, sure, at_stop, line, thai)


def _stop_keys(b: Block, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, word before, whether it touches) of the word and stop that each run of stops ends."""
    stop = b.cp[b.te[b.last_stop[run]] - 1]
    before = np.maximum(b.first_stop[run] - 1, 0)
    touching = (b.first_stop[run] > 0) & (b.te[before] == b.ts[b.first_stop[run]])
    keys = mix(np.where(touching, b.left[before], np.uint64(0)), np.where(stop == 0xFF0E, 0x2E, stop).astype(np.uint64))
    return keys, before, touching


def _keys(b: Block) -> np.ndarray:
    """The number of each word as an n-gram's part: characters of scripts without blanks by two, numbers as one."""
    out = np.where(b.tc == DIGIT, np.uint64(NUMBER), b.h)
    i = np.flatnonzero(b.tc[:-1] == DENSE) if b.n else np.zeros(0, np.int64)
    i = i[b.tc[i + 1] == DENSE]
    out[i] = mix(b.h[i], b.h[i + 1])
    return out


def _places(b: Block, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(place as a word after, place as a word before) of each word; other words have the places of their classes."""
    v = len(model.word_keys)
    other = np.where(b.tc == DIGIT, v + _OTHER_NUMBER, np.where(b.tc == DENSE, v + _OTHER_DENSE, np.where(b.tc == UPPER, v + _OTHER_CAP, v + _OTHER_LOW)))
    after = model.index("word").find(_keys(b))
    after = np.where(after >= 0, after, other)
    before = after.copy()
    i = np.flatnonzero(b.tc == DENSE)
    i = i[i > 0]
    i = i[b.tc[i - 1] == DENSE]
    before[i] = after[i - 1]  # the pair of characters that ends there
    return after, before


def _classes(model: Model, place: np.ndarray, capital: np.ndarray) -> np.ndarray:
    """The class of the word at each place; a word without one of its own has that of its case."""
    c = np.append(model.classes, np.arange(4))[place]
    return np.where(c >= 0, c, np.where(capital, _OTHER_CAP, _OTHER_LOW))


def score(b: Block, model: Model) -> Scored:
    gap, kind = b.gap, b.gap_kind
    n = len(gap)
    words_after, words_before = _places(b, model)
    if not n:
        none = np.zeros(0)
        return Scored(none, none, none, None, none, words_after, words_before)
    m = _features(b)
    v = len(model.word_keys)
    capital = (b.tc == UPPER).astype(np.int64)
    right = np.minimum(m.right, b.n - 1)
    known = (words_after[right] < v) & (b.tc[right] != SIGN) & (b.tc[right] != DIGIT)
    first = np.where(known, np.append(model.first, np.zeros((4, 2)), 0)[words_after[right], capital[right]], 0.0)
    told = np.zeros(len(m.at))
    s = np.flatnonzero(m.stop)
    if len(s):
        k = kind[m.at[s]]
        keys, before, touching = _stop_keys(b, b.stop[m.at[s]])
        place = model.index("stop").find(keys)
        lam = np.where(place >= 0, np.append(model.stop_odds, 0.0)[place], _logit(np.array(0.97)))
        as_blank = np.where(k == NOTHING, SPACE, k)
        o = lam + np.log(model.gap[1] / model.gap[0])[as_blank]
        opening = np.concatenate([[0], np.cumsum(b.is_sign(OPENERS))])
        quoted = opening[m.right[s]] > opening[m.gap[s] + 1]
        number = touching & (b.tc[before] == DIGIT)
        low = np.where(number, -3.0, np.where(lam > _logit(np.array(0.8)), -1.0, -2.0))
        # a word behind an abbreviation at a wrapped line counts as a first word too, so it's no sign for a boundary there
        high = np.where(lam < _logit(np.array(0.1)), 0.0, 1.5)
        o += np.where(quoted, 0.0, np.clip(first[s], low, high))
        string = np.where((k == SPACE) | (k == LINE), b.unbroken(m.gap[s]), 0)
        told[s] = o + np.where(string > 0, np.clip(string / 8 - 4, 0, 12), 0.0)  # no word of any language is so long
    s = np.flatnonzero(m.line)
    if len(s):
        g = m.gap[s]
        place = model.index("end").find(np.where(b.tc[g] == DIGIT, b.left[g], b.h[g]))
        o = np.where(place >= 0, np.append(model.end_odds, 0.0)[place], 0.0) + 0.5 * first[s]
        o += np.where((m.right_kind[s] == UPPER) | (m.right_kind[s] == CASELESS), 1.0, -1.0)
        told[s] = o + model.length[b.line_words(g)]
    told = np.where(m.sure == 0, told, np.clip(told, -LIGHT, LIGHT) + HEAVY * m.sure)
    told[kind[m.at] == PARAGRAPH] = 40.0
    odds, after_first = np.full(n, math.log(OMITTED) - 2), np.ones(n)
    odds[m.at] = told
    is_marked = np.zeros(n, bool)
    is_marked[m.at[m.stop | m.line | m.thai]] = True
    if model.last is not None:
        plain = np.flatnonzero(~is_marked & b.wordy[gap] & b.wordy[gap + 1] & ~b.inside(gap))
        g = gap[plain]
        nxt = g + 1
        # the style of a paragraph: how likely it lacks stops, by its length in sentences and by its stops and line ends
        ends = np.flatnonzero(b.kinds == PARAGRAPH)
        start, end = np.concatenate([[0], ends[:-1] + 1]), ends + 1
        length = np.concatenate([[0.0], np.cumsum(np.where(b.wordy, np.where(b.tc == DENSE, 1 / model.span[1], 1 / model.span[0]), 0.0))])
        marks = np.zeros(b.n + 1)
        marks[m.gap[m.stop & (m.sure >= 0) | m.line | m.thai] + 1] = 1.0
        marks = np.cumsum(marks)
        style = math.log(BARE) + (length[end] - length[start]) / 2 + (marks[end - 1] - marks[start]) * math.log(KEPT)
        bare = 1 / (1 + np.exp(-np.clip(style, -40, 40)))
        omitted = np.repeat(np.log(bare + (1 - bare) * OMITTED), end - start)
        ca, cb = _classes(model, words_after[nxt], capital[nxt] == 1), _classes(model, words_before[g], capital[g] == 1)
        spaced = (b.tc[g] != DENSE) & (b.tc[nxt] != DENSE)
        odds[plain] = model.last[words_before[g]] + model.begin[words_after[nxt], capital[nxt]] - np.where(spaced, model.pair[cb, ca], 0.0) + omitted[g]
        second = np.flatnonzero(spaced & (np.concatenate([[-1], gap[:-1]])[plain] == g - 1))  # the first word's own gap stands right before
        after_first[plain[second]] = model.follow[cb[second], ca[second]]
    link = np.ones(n)
    link[1:][~is_marked[1:]] = MARK_ALONE
    s = m.at[m.stop]
    s = s[s > 0]
    s = s[b.words_before[gap[s] + 1] - b.words_before[gap[s - 1] + 1] == 1]
    w = np.minimum(gap[s - 1] + 1, b.n - 1)
    w = np.where(b.wordy[w], w, np.minimum(w + 1, b.n - 1))
    size = b.te[w] - b.ts[w]
    link[s] = np.where((b.tc[w] == DIGIT) | (size == 1) & (b.tc[w] == UPPER), MARK_ALONE, np.where(size <= 3, SHORT, 1.0))
    return Scored(odds, link, after_first, m, is_marked, words_after, words_before)


def posteriors(odds: np.ndarray, link: np.ndarray, after_first: np.ndarray, width: int = 64) -> np.ndarray:
    """Forward-backward: P(boundary) of each gap of a chain.

    A path's weight is the product of each event's own probability, times
    ``link`` where a gap and the one before it are boundaries both, times
    ``after_first`` where only the one before is. The chain is cut into rows of
    ``width`` gaps; the rows' transfer matrices are multiplied out side by side,
    chained once, and then each row is filled, side by side again, so that the
    result is exact.
    """
    n = len(odds)
    if not n:
        return np.zeros(0)
    rows = -(-n // width)

    def table(x: np.ndarray | float, fill: float) -> np.ndarray:
        out = np.full(rows * width, fill)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(rows, width).T)  # a step of all rows lies together

    yes = table(1 / (1 + np.exp(-np.clip(odds, -700, 700))), 0.0)
    no = 1 - yes
    # steps [[no, yes], [no_b, yes_b]], the second row behind a boundary
    yes_b, no_b = yes * table(link, 1.0), no * table(after_first, 1.0)
    m = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
    for k in range(width):
        m = [m[0] * no[k] + m[1] * no_b[k], m[0] * yes[k] + m[1] * yes_b[k], m[2] * no[k] + m[3] * no_b[k], m[2] * yes[k] + m[3] * yes_b[k]]
        if k % 8 == 7:
            size = m[0] + m[1] + m[2] + m[3]
            m = [x / size for x in m]
    m0, m1, m2, m3 = (x.tolist() for x in m)
    enter, leave = np.empty((2, rows)), np.empty((2, rows))
    f0, f1 = 1.0, 0.0
    for r in range(rows):
        enter[:, r] = f0, f1
        f0, f1 = f0 * m0[r] + f1 * m2[r], f0 * m1[r] + f1 * m3[r]
        z = f0 + f1
        f0, f1 = f0 / z, f1 / z
    b0 = b1 = 1.0
    for r in range(rows - 1, -1, -1):
        leave[:, r] = b0, b1
        b0, b1 = m0[r] * b0 + m1[r] * b1, m2[r] * b0 + m3[r] * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    forward = np.empty((width, 2, rows))
    f0, f1 = enter
    for k in range(width):
        f0, f1 = f0 * no[k] + f1 * no_b[k], f0 * yes[k] + f1 * yes_b[k]
        z = f0 + f1
        f0, f1 = f0 / z, f1 / z
        forward[k, 0], forward[k, 1] = f0, f1
    out = np.empty((width, rows))
    b0, b1 = leave
    for k in range(width - 1, -1, -1):
        x0, x1 = forward[k, 0] * b0, forward[k, 1] * b1
        out[k] = x1 / (x0 + x1)
        b0, b1 = no[k] * b0 + yes[k] * b1, no_b[k] * b0 + yes_b[k] * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    return out.T.reshape(-1)[:n]


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the units of a text, without white space at their ends; together they hold every other character."""
    b = Block([text])
    s = score(b, model)
    _, start, end = b.spans(np.flatnonzero(posteriors(s.odds, s.link, s.after_first) > 0.5))
    return list(zip(start.tolist(), end.tolist(), strict=True))


# Counting

_COUNT = np.dtype([("key", np.uint64), ("kind", np.int64), ("n", np.float64)])
_STOPS, _WORDS, _ENDS, _LENGTHS, _AROUND, _PAIRS, _OPENINGS = range(7)


class Counter:
    """Counts by (table, key, kind): a key's low bits are free (see ``mix``) and hold the kind."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, tab: int, key: np.ndarray, kind: np.ndarray) -> None:
        self.parts.setdefault(tab, []).append(np.unique(key | kind.astype(np.uint64), return_counts=True))
        if len(self.parts[tab]) > 64:
            self.parts[tab] = [self._sum(tab)]

    def _sum(self, tab: int) -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate(x) for x in zip(*self.parts[tab], strict=True))
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[at], np.add.reduceat(n, at) if len(at) else n

    def rows(self, tab: int) -> np.ndarray:
        codes, n = self._sum(tab) if tab in self.parts else (np.zeros(0, np.uint64), np.zeros(0))
        out = np.empty(len(codes), _COUNT)
        out["key"], out["kind"], out["n"] = codes & ~np.uint64(7), codes & np.uint64(7), n
        return out

    def batch(self) -> pa.RecordBatch:
        tables = [(tab, self.rows(tab)) for tab in sorted(self.parts)]
        r = np.concatenate([np.empty(0, _COUNT), *(rows for _, rows in tables)])
        tab = np.concatenate([np.empty(0, np.int32), *(np.full(len(rows), t, np.int32) for t, rows in tables)])
        return pa.RecordBatch.from_arrays([pa.array(tab), pa.array(r["key"].view(np.int64)), pa.array(r["kind"].astype(np.int32)), pa.array(r["n"])], names=["tab", "key", "kind", "n"])


def _count_forms(b: Block, out: Counter) -> None:
    """The counts of the first pass: stops, first words, line ends and the lengths of lines."""
    if not b.n:
        return
    first = np.zeros(b.n + 1, bool)
    first[0] = True
    unsure, ends = np.zeros(b.n + 1, bool), np.zeros(b.n + 1, bool)
    if len(b.gap):
        m = _features(b, counting=True)
        kind = b.gap_kind[m.at]
        s = np.flatnonzero(m.stop & (kind != NOTHING) & (m.sure >= 0) & (m.right_kind != LOWER))
        keys, before, touching = _stop_keys(b, b.stop[m.at[s]])
        out.add(_STOPS, keys, kind[s] + 4 * (touching & b.is_short[before]))
        first[m.right[m.stop & ((m.sure > 0) | (kind == LINE) | (kind == PARAGRAPH)) | m.line & (m.sure > 0)]] = True
        unsure[m.right[m.stop]] = True
        ends[m.gap[m.line]] = True
        t = m.gap[m.line & ((kind == PARAGRAPH) & ~b.ends_text(m.gap) | (m.right_kind == LOWER) & (m.sure < 0))]
        out.add(_LENGTHS, b.line_words(t).astype(np.uint64) * np.uint64(8), (b.kinds[t] == PARAGRAPH).astype(np.int64))
    use = np.flatnonzero(b.wordy & (first[:-1] | ~unsure[:-1]))
    out.add(_WORDS, _keys(b)[use], 2 * (b.tc[use] == UPPER) + first[use])
    w = np.flatnonzero(b.wordy)
    out.add(_ENDS, np.where(b.tc[w] == DIGIT, b.left[w], b.h[w]), ends[w].astype(np.int64))


class AroundCounter:
    """Counts of the second pass by place and class, whose number the model bounds, as dense arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.classes = np.append(model.classes, np.arange(4))
        self.words = np.zeros((6, len(model.word_keys) + 4))
        self.pairs = np.zeros((int(max(3, self.classes.max())) + 1,) * 2)
        self.openings = np.zeros_like(self.pairs)

    def add(self, b: Block) -> None:
        """Words last before and first after a boundary, and pairs of classes without one between, by posterior."""
        w = np.flatnonzero(b.wordy)
        if not len(w):
            return
        s = score(b, self.model)
        q = np.zeros(b.n)
        q[b.gap] = posteriors(s.odds, s.link, s.after_first)
        v, c = self.words.shape[1], len(self.pairs)
        edge = np.maximum.reduceat(q, w)  # the likeliest boundary before the next word
        edge[-1] = 1.0
        last = s.before[w]
        self.words[0] += np.bincount(last, edge, v)
        self.words[1] += np.bincount(last, 1 - edge, v)
        x, e = w[1:], edge[:-1]
        first, capital = s.after[x], b.tc[x] == UPPER
        for k, rows in ((2, ~capital), (4, capital)):
            self.words[k] += np.bincount(first[rows], 1 - e[rows], v)
            self.words[k + 1] += np.bincount(first[rows], e[rows], v)
        ca, cb = _classes(self.model, first, capital), _classes(self.model, last[:-1], b.tc[w[:-1]] == UPPER)
        near = (np.diff(w) == 1) & (b.tc[x] != DENSE) & (b.tc[w[:-1]] != DENSE)
        both = cb[near] * c + ca[near]
        self.pairs += np.bincount(both, (1 - e)[near], c * c).reshape(c, c)
        self.openings += np.bincount(both, ((1 - e) * np.concatenate([[1.0], e[:-1]]))[near], c * c).reshape(c, c)

    def batch(self) -> pa.RecordBatch:
        out = []
        for tab, table in ((_AROUND, self.words), (_PAIRS, self.pairs), (_OPENINGS, self.openings)):
            i, j = np.nonzero(table)
            key, kind = (j, i) if tab == _AROUND else (i, j)
            out.append((np.full(len(i), tab, np.int32), key.astype(np.int64), kind.astype(np.int32), table[i, j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["tab", "key", "kind", "n"])


def _blocks(texts: Sequence[str | None]) -> Iterator[tuple[list[int], Block]]:
    """(rows, block) of the texts of a batch."""
    rows: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if not t:
            continue
        rows.append(k)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield rows, Block([texts[r] for r in rows])
            rows, size = [], 0
    if rows:
        yield rows, Block([texts[r] for r in rows])


def _count(df: DataFrame, text: str, model: Model | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, around = Counter(), None if model is None else AroundCounter(model)
        for batch in batches:
            for _, block in _blocks(batch.column(0).to_pylist()):
                if around is None:
                    _count_forms(block, forms)
                else:
                    around.add(block)
        yield forms.batch() if around is None else around.batch()

    counted = df.select(text).mapInArrow(run, "tab int, key bigint, kind int, n double")
    return counted.groupBy("tab", "key", "kind").agg(F.sum("n").alias("n"))


def _tables_of(counts: DataFrame) -> dict[int, np.ndarray]:
    t = counts.select("tab", "key", "kind", "n").toArrow()
    tab = t.column("tab").to_numpy()
    rows = np.empty(len(tab), _COUNT)
    rows["key"] = t.column("key").to_numpy().astype(np.int64).view(np.uint64)
    rows["kind"], rows["n"] = t.column("kind").to_numpy(), t.column("n").to_numpy()
    return {k: rows[tab == k] for k in range(7)}


def fit(df: DataFrame, text: str = "text") -> Model:
    """The model of a corpus, from counts over all texts.

    Of each table the driver gets the keys with at least ``SHARE`` of its
    occurrences (of its events at stops, of all words, of all line ends), at most
    2^18 of them; the second pass counts by places and classes, whose number is
    bounded by the same.
    """
    counts = materialize(_count(df, text, None))
    weight = F.when((F.col("tab") == _ENDS) & (F.col("kind") == 0), 0.0).otherwise(F.col("n"))
    totals = {r["tab"]: (r["n"], r["all"]) for r in counts.groupBy("tab").agg(F.sum(weight).alias("n"), F.sum("n").alias("all")).collect()}
    own = counts.groupBy("tab", "key").agg(F.sum(weight).alias("n"))
    least = F.element_at(F.map_from_arrays(F.array(*(F.lit(k) for k in range(4))), F.array(*(F.lit(SHARE * float(totals.get(k, (0.0, 0.0))[0] or 0.0)) for k in range(4)))), F.col("tab"))
    kept = own.filter((F.col("tab") == _LENGTHS) | (F.col("n") > 0) & (F.col("n") >= least)).select("tab", "key")
    tables = _tables_of(counts.join(kept, ["tab", "key"], "left_semi"))
    discard(counts)
    model = Model.fit(tables[_STOPS], tables[_WORDS], tables[_ENDS], tables[_LENGTHS], int(totals.get(_WORDS, (0, 0))[1] or 0))
    around = _tables_of(_count(df, text, model))
    return model.refit(around[_AROUND], around[_PAIRS], around[_OPENINGS])


def split_documents(df: DataFrame, model: Model, key: str = "id", text: str = "text", once: bool = False) -> DataFrame:
    """(key, sentence_no, start_pos, end_pos) of the units of each text.

    Null, empty and blank texts have none; repeated rows give theirs again, or
    with ``once`` the units of one of the texts of a key; further columns are
    left out, whatever their names. For ``once`` a text's units travel as one
    row of offsets, which is far smaller than the text.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, b in _blocks(batch.column(1).to_pylist()):
                s = score(b, model)
                which, start, end = b.spans(np.flatnonzero(posteriors(s.odds, s.link, s.after_first) > 0.5))
                first = np.searchsorted(which, np.arange(len(rows) + 1)).astype(np.int32)
                offsets = pa.array(first)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows, np.int64))), *lists], names=[key, "starts", "ends"])

    units = df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, starts array<int>, ends array<int>")
    if once:
        units = units.groupBy(key).agg(F.any_value(F.struct("starts", "ends")).alias("u")).select(key, "u.*")
    spans = units.select(key, F.posexplode(F.arrays_zip("starts", "ends")).alias("sentence_no", "s"))
    return spans.select(key, "sentence_no", F.col("s.starts").alias("start_pos"), F.col("s.ends").alias("end_pos"))
