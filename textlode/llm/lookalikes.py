"""Text that looks the same brought to one form.

A weighted edit automaton reads characters against the tries of a vocabulary:
look-alikes, widths, composed and decomposed accents, and kinds of blank cost
nothing, ignorable characters cost nothing to skip, an accent more or less costs
one, and any other edit two. With no budget for edits the automaton is
deterministic: it is run as a translation into classes of look-alikes followed by
a traversal of the trie of class strings, both of which leave the interpreter.
Tokens that the vocabulary knows get its canonical spelling; others are
normalized by the table. What looks the same must come out the same wherever it
stands, so that a token's spelling depends on its class string alone, never on
the text or language around it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.core.jstext import WS_CHARS
from textlode.core.session import materialize

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԁԛԝӏүҮӀ", "ABESIJKMHOPCTYXQWaesijopcyxhdqwlyYI", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏕᏞᏟᏢᏤᏦᏧᏴ", "DRTAJEWMHYGZbRSLCPVKdB", strict=True))
OTHER = {"ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "‐": "-", "‑": "-", "⁄": "/", "∕": "/", "․": ".", "ꞌ": "'", "ʼ": "’", "ʹ": "′"}
LOOKALIKES = {**CYRILLIC, **GREEK, **CHEROKEE, **OTHER}
# Kinds of compatibility mapping that only change a character's width, font or form.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
_LIGATURES = ((0xFB00, 0xFB07), (0xFB13, 0xFB18), (0x2160, 0x2180), (0xB5, 0xB6), (0x2F00, 0x2FD6))
# Ranges of characters that aren't shown.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
BLANKS = (set(WS_CHARS) | {"\x1c", "\x1d", "\x1e", "\x1f", "\x85"}) - {"\N{ZERO WIDTH NO-BREAK SPACE}"}


def _unfold(ch: str) -> str:
    """One character without its width, font or positional form, canonically decomposed."""
    d = unicodedata.decomposition(ch)
    if d.startswith("<"):
        kind, _, rest = d.partition(" ")
        if kind in SAME_LOOK or any(a <= ord(ch) < b for a, b in _LIGATURES):
            return "".join(_unfold(chr(int(x, 16))) for x in rest.split())
        return ch
    n = unicodedata.normalize("NFD", ch)
    return n if n == ch else "".join(map(_unfold, n))


class _Table(dict[int, str]):
    """A translation table that works out an entry when it's first needed, so that it holds only characters that occur."""

    def __init__(self, same: bool):
        super().__init__()
        self.same = same

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if any(a <= code <= b for a, b in IGNORABLE):
            out = ""
        elif ch in BLANKS:
            out = " "
        else:
            out = "".join(LOOKALIKES.get(c, c) if self.same else c for c in _unfold(ch))
        self[code] = out
        return out


_CLASSES, _PLAIN = _Table(True), _Table(False)
_RUNS = re.compile("  +")
_MARKS = re.compile("[\N{COMBINING GRAVE ACCENT}-\N{COMBINING LATIN SMALL LETTER X}]{2,}")


def _translate(text: str, table: _Table) -> str:
    out = text.translate(table)
    if "  " in out:
        out = _RUNS.sub(" ", out)
    if not out.isascii() and _MARKS.search(out):
        out = unicodedata.normalize("NFD", out)  # puts marks of one letter into their one order
    return out


def class_string(text: str) -> str:
    """The look-alike classes of a text: equal for two texts exactly where a reader sees no difference."""
    return _translate(text, _CLASSES)


#: Costs of the edits that a reader sees; look-alikes and ignorables cost nothing.
ACCENT, VISIBLE = 1, 2


def _cost(c: str) -> int:
    return ACCENT if unicodedata.combining(c) else VISIBLE


class LookalikeTrie:
    """A vocabulary as a trie of class strings.

    ``scan`` runs the automaton without budget over a text and yields the
    entries that a stretch of it looks like; ``search`` matches one whole token
    within a budget of visible edits.
    """

    def __init__(self, entries: Iterable[str]):
        self.canonical: dict[str, str] = {}
        for e in entries:
            self.canonical.setdefault(class_string(e), e)
        self.nodes: dict | None = None

    @cached_property
    def trie(self) -> ahocorasick.Automaton:
        trie = ahocorasick.Automaton()
        for k, e in self.canonical.items():
            if k:
                trie.add_word(k, e)
        if len(trie):
            trie.make_automaton()
        return trie

    def scan(self, text: str) -> Iterator[str]:
        if len(self.trie):
            read = class_string(text)
            for end, e in self.trie.iter(read):
                # a stretch never ends between a letter and its mark
                if end + 1 == len(read) or unicodedata.category(read[end + 1])[0] != "M":
                    yield e

    def search(self, token: str, budget: int = 0) -> tuple[str, int] | None:
        """(canonical spelling, cost) of the cheapest entry within the budget, the smallest spelling on ties."""
        key = class_string(token)
        if key in self.canonical:
            return self.canonical[key], 0
        if budget <= 0:
            return None
        if self.nodes is None:
            self.nodes = {}
            for k, e in self.canonical.items():
                node = self.nodes
                for c in k:
                    node = node.setdefault(c, {})
                node[None] = e
        best: list[tuple[int, str]] = []
        skip = [_cost(c) for c in key]
        # a state of the automaton: the cost of each place in the token for one node
        stack = [(self.nodes, [0, *accumulate(skip)])]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c is None:
                    if row[-1] <= budget:
                        best.append((row[-1], child))
                    continue
                insert = _cost(c)
                new = [row[0] + insert]
                for k, x in enumerate(key):
                    new.append(min(new[-1] + skip[k], row[k + 1] + insert, row[k] + (x != c) * max(insert, skip[k])))
                if min(new) <= budget:
                    stack.append((child, new))
        return (min(best)[1], min(best)[0]) if best else None


# Which script a token of look-alikes is written in is told by its other letters.
_TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC.items())}
_TO_GREEK = {v: k for k, v in reversed(GREEK.items())}
_AMBIGUOUS = set(_TO_CYRILLIC) | set(_TO_GREEK)
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\N{COMBINING GRAVE ACCENT}-\N{COMBINING LATIN SMALL LETTER X}])*")
_CYR = re.compile("[Ѐ-ԯ]")
_GRK = re.compile("[Ͱ-Ͽ]")


def is_ambiguous(token: str) -> bool:
    """Whether every letter of a class string has look-alikes in another script, so that only a vocabulary tells which it is."""
    return all(c in _AMBIGUOUS or unicodedata.combining(c) for c in token)


def _by_table(m: re.Match[str]) -> str:
    """A token of classes in one script: that of its letters without look-alikes; Latin where they're all ambiguous."""
    t = m[0]
    if t.isascii():
        return t
    cyr, grk = _CYR.search(t), _GRK.search(t)
    if bool(cyr) == bool(grk) or any("a" <= c.lower() <= "z" and c not in _AMBIGUOUS for c in t):
        return t
    back = _TO_CYRILLIC if cyr else _TO_GREEK
    return "".join(back.get(c, c) for c in t)


_ODD_BLANK = re.compile(r"[\t-\r\x1c-\x1f]|  ")


def canonical(text: str | None, vocabulary: LookalikeTrie | None = None) -> str | None:
    """The one form of all texts that look like ``text``: composed, in plain width, each token in one script.

    ``vocabulary``: spellings of tokens whose letters are all ambiguous.
    """
    if text is None:
        return None
    known = vocabulary is not None and len(vocabulary.canonical) > 0
    if text.isascii() and not known and not _ODD_BLANK.search(text):
        return text
    out = class_string(text)
    if not out.isascii():
        out = _TOKEN.sub(_by_table, out)
    if known:
        out = _TOKEN.sub(lambda m: hit[0] if (hit := vocabulary.search(m[0])) else m[0], out)
    return unicodedata.normalize("NFC", out)


def ambiguous_tokens(text: str | None) -> list[tuple[str, str]]:
    """(class string, spelling) of the tokens of a text whose letters are all ambiguous."""
    if not text:
        return []
    plain = _translate(text, _PLAIN)
    out = []
    for m in _TOKEN.finditer(plain):
        key = class_string(m[0])
        if is_ambiguous(key):
            out.append((key, unicodedata.normalize("NFC", m[0])))
    return out


def find_lookalikes(extractions: DataFrame, sources: DataFrame) -> DataFrame:
    """(extraction_id) of each distinct extraction whose text isn't in its source character for character while a stretch looks like it.

    Joined by resolve_id, nulls never match. Texts found as they are leave in
    the JVM; for the others the texts of one source in a batch form the
    vocabulary trie that the automaton reads the source against. An empty text
    is in every source as it is; one of ignorables alone looks like nothing.
    """
    e = extractions.select("extraction_id", "resolve_id", "text").filter("text is not null")
    s = sources.select(F.col("resolve_id").alias("_rid"), "source_text").filter("source_text is not null")
    pairs = e.join(s, F.col("resolve_id") == F.col("_rid")).filter(~F.contains("source_text", "text")).select("extraction_id", "text", "source_text")
    kind = dict(extractions.dtypes)["extraction_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_source: dict[str, list[tuple[int, str]]] = defaultdict(list)
            for k, (t, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                by_source[source].append((k, class_string(t).strip(" ")))
            keep: list[int] = []
            for source, wanted in by_source.items():
                trie = LookalikeTrie(t for _, t in wanted)
                seen = set(trie.scan(source))
                keep += [k for k, t in wanted if t and t in seen]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sorted(keep), pa.int64()))], names=["extraction_id"])

    return pairs.mapInArrow(run, f"extraction_id {kind}").distinct()


#: Letters of a Latin token that may be of another script.
_LATIN = "".join(sorted(c for c in _AMBIGUOUS if c.isascii() and c.isalpha()))


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """(key, spelling) of the ambiguous tokens that the corpus spells mostly in another way than the table does.

    Counts cover all rows. Ties go to the table's Latin spelling, then to the
    smallest. Only text beyond ASCII leaves the JVM: an ASCII text spells its
    tokens as the table does, and these are counted by expression. Counts are
    summed inside each partition, so a token that most rows share is a row of
    each partition when it's shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for pair in ambiguous_tokens(t):
                    counts[pair] += 1
            if len(counts) > MAX_COUNTS:
                yield _count_batch(counts)
                counts.clear()
        yield _count_batch(counts)

    beyond = F.col(column).rlike(r"[^\x00-\x7f]")
    spelt = texts.select(column).filter(beyond).mapInArrow(run, "key string, spelling string, c bigint")
    totals = spelt.groupBy("key", "spelling").agg(F.sum("c").alias("c"))
    tokens = F.explode(F.regexp_extract_all(column, F.lit(rf"(?<![A-Za-z])([{_LATIN}]+)(?![A-Za-z])"), F.lit(1)))
    plain = texts.select(column).filter(~beyond).select(tokens.alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    totals = totals.unionByName(plain.select("key", F.col("key").alias("spelling"), "c")).groupBy("key", "spelling").agg(F.sum("c").alias("c"))
    order = F.struct((-F.col("c")).alias("c"), (F.col("key") != F.col("spelling")).alias("other"), F.col("spelling").alias("s"))
    return totals.groupBy("key").agg(F.min(order).alias("o")).select("key", F.col("o.s").alias("spelling")).filter("key <> spelling")


#: Different tokens that a task counts before it hands them on.
MAX_COUNTS = 500_000
#: Entries of a vocabulary that is sent to all executors at most; a larger one is joined.
MAX_BROADCAST_WORDS = 100_000


def _count_batch(counts: dict[tuple[str, str], int]) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["key", "spelling", "c"])


def canonical_texts(df: DataFrame, key: str, column: str, words: DataFrame) -> DataFrame:
    """(key, text, canonical) of each row; null texts stay null, repeated rows stay repeated. ``words``: the (key, spelling) vocabulary.

    A vocabulary of at most MAX_BROADCAST_WORDS entries goes to the executors as
    a trie, and the texts are gone through once, without a shuffle. A larger one
    is joined by token: texts are known there by a fingerprint of 128 bits, and
    the pairs of text and token are spread by both, so that neither a text nor a
    token that many rows share comes into one task.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(column).alias("text"))
    schema = f"`{key}` {kind}, text string, canonical string"
    words = materialize(words)
    if words.count() <= MAX_BROADCAST_WORDS:
        spellings = [r["spelling"] for r in words.select("spelling").collect()]

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = LookalikeTrie(spellings)
            for batch in batches:
                texts = batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([canonical(t, trie) for t in texts.to_pylist()], pa.string())], names=[key, "text", "canonical"])

        return rows.mapInArrow(spell, schema)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[bytes, str]] = set()
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.update((h, k) for k, _ in ambiguous_tokens(t))
            pairs = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.binary()), pa.array([k for _, k in pairs], pa.string())], names=["_h", "_token"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            new = [canonical(t, LookalikeTrie(own) if own else None) for t, own in zip(texts.to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(new, pa.string())], names=[key, "text", "canonical"])

    salt = F.pmod(F.xxhash64("_h"), F.lit(SALTS)).cast("int")
    hashed = rows.withColumn("_h", F.unhex(F.md5("text")))
    wanted = hashed.filter("text is not null").select("_h", "text").mapInArrow(tokens, "_h binary, _token string").distinct().withColumn("_salt", salt)
    salted = words.select(F.col("key").alias("_token"), F.col("spelling").alias("_spelling"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = wanted.join(salted, ["_token", "_salt"]).groupBy("_h").agg(F.collect_set("_spelling").alias("_own"))
    # rows of a text that very many share lie in several parts, each with its tokens
    spread = hashed.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(own, ["_h", "_part"], "left").select(key, "text", "_own").mapInArrow(write, schema)


#: Parts that the rows of one text or token are spread over.
SALTS = 16
