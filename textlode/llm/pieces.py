"""Oversized texts cut into pieces under a limit, at natural boundaries, each sharing a given overlap with the one before.

The boundaries of a text are one sorted array of offsets for each kind (ends of
sentences and lines, white space, token edges), taken from its token offsets;
each cut is a binary search for the last boundary under the limit, the next
piece starts an overlap earlier, and where no boundary lies in reach the cut is
hard. Work is linear in the text and one row holds one text, so no step
shuffles; only the option table, whose size is checked, is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.core.jstext import WS_CHARS, not_blank

DEFAULT_PROFILE = "default"
#: Option tables of this many rows or more are joined by shuffle.
MAX_BROADCAST_OPTIONS = 10_000

_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS) + "]"
# Places where a text is naturally cut, the best first; each match ends at a cut.
_SENTENCE_END = regex.compile(
    r"""(?:[.?!…]+["'”’»)\]}]*(?=[\s\p{Z}\N{ZERO WIDTH NO-BREAK SPACE}])|[。！？।۔؟።]["'”’»」』》）)\]}]*)"""
)
_LINE_END = regex.compile(r"[^\r\n](?=[\r\n])")
_WORD_END = regex.compile(r"[^\s\p{Z}\N{ZERO WIDTH NO-BREAK SPACE}](?=[\s\p{Z}\N{ZERO WIDTH NO-BREAK SPACE}])")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|([^\p{L}\p{N}\s\p{Z}\N{ZERO WIDTH NO-BREAK SPACE}]|_)\1*")
#: A cut never lies before one of these, which belong to the character in front.
_JOINED = regex.compile(r"[\p{M}\N{ZERO WIDTH JOINER}\N{VARIATION SELECTOR-16}\U0001f3fb-\U0001f3ff]|(?<=\N{ZERO WIDTH JOINER}).", regex.DOTALL)


@dataclass
class Boundaries:
    """Sorted offsets at which a text may be cut, by kind, the most natural first."""

    kinds: list[np.ndarray]
    joined: np.ndarray

    @classmethod
    def of(cls, text: str) -> Boundaries:
        ends = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in (_SENTENCE_END, _LINE_END, _WORD_END, _TOKEN)]
        joined = np.fromiter((m.start() for m in _JOINED.finditer(text)), np.int64)
        ends[0] = np.union1d(ends[0], ends[1])
        return cls([np.setdiff1d(e, joined, assume_unique=False) for e in (ends[0], ends[2], ends[3])], joined)

    def last(self, low: int, high: int) -> int | None:
        """The last boundary in (low, high] of the most natural kind that has one."""
        for ends in self.kinds:
            k = int(np.searchsorted(ends, high, "right")) - 1
            if k >= 0 and ends[k] > low:
                return int(ends[k])
        return None


    def hard(self, low: int, high: int) -> int:
        """The last place in (low, high] that parts no character from what belongs to it; ``high`` where there's none."""
        at = high
        k = int(np.searchsorted(self.joined, high, "right")) - 1
        while k >= 0 and self.joined[k] == at and at - 1 > low:
            at, k = at - 1, k - 1
        return at if k < 0 or self.joined[k] != at else high


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of the pieces of ``text`` from its first to its last character that isn't white space.

    Every piece but the first starts exactly ``overlap`` characters before the
    end of the one before. An overlap of the limit or more is taken as one less
    than the limit, so that pieces advance; a limit under 1 counts as 1. A text
    within the limit is one piece, a blank one none. Pieces hold limit / (limit -
    overlap) times the text, so an overlap near the limit makes very many. A hard
    cut keeps a letter with its marks unless these alone are over the limit.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    stop = len(text.rstrip(WS_CHARS))
    start = len(text) - len(text.lstrip(WS_CHARS))
    if start >= stop:
        return []
    if stop - start <= limit:
        return [(start, stop, "end")]
    found = Boundaries.of(text)
    out: list[tuple[int, int, str]] = []
    fresh = start  # up to here all is covered
    while True:
        high = start + limit
        if high >= stop:
            out.append((start, stop, "end"))
            return out
        at = found.last(max(fresh, start + overlap), high)
        kind = "natural"
        if at is None:
            at, kind = found.hard(max(fresh, start + overlap), high), "hard"
        out.append((start, at, kind))
        fresh, start = at, at - overlap


def with_limits(docs: DataFrame, options: DataFrame) -> DataFrame:
    """``docs`` with the limit and overlap of the profile that the metadata name, those of ``default`` where none is named.

    A blank name counts as none. A profile that the options lack gives nulls: such texts aren't cut.
    """
    o = options.select(F.col("profile").alias("_profile"), F.col("max_char_buffer").alias("_limit"), F.col("overlap_chars").alias("_overlap")).dropDuplicates(["_profile"])
    if o.limit(MAX_BROADCAST_OPTIONS).count() < MAX_BROADCAST_OPTIONS:
        o = F.broadcast(o)
    named = F.try_element_at("metadata", F.lit("chunkProfile"))
    return docs.withColumn("_name", F.when(F.coalesce(not_blank(named), F.lit(False)), named).otherwise(DEFAULT_PROFILE)).join(o, F.col("_name") == F.col("_profile"), "left").drop("_profile")


def trimmed_length(c: str) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(c, rf"\A{_WS}++", ""), rf"{_WS}++\z", ""))


def cut_documents(docs: DataFrame, options: DataFrame, key: str = "id", oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, cut[, piece]) of the pieces of each text; their text only ``with_text``.

    Null and blank texts have no pieces; repeated rows give their pieces again,
    so drop repeats first where they matter. With ``oversized_only`` texts within
    their limit are left out, in the JVM and before Python sees them.
    """
    df = with_limits(docs.select(key, "text", "metadata"), options).filter(F.col("_limit").isNotNull() & F.col("text").isNotNull())
    if oversized_only:
        df = df.filter((F.length("text") > F.col("_limit")) & (trimmed_length("text") > F.col("_limit")))
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, piece_no int, start_pos int, end_pos int, cut string" + ", piece string" * with_text
    names = [key, "piece_no", "start_pos", "end_pos", "cut"] + ["piece"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, no, starts, ends, kinds, texts = [], [], [], [], [], []
            for k, (t, limit, overlap) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for n, (a, b, how) in enumerate(cut(t, limit, overlap or 0)):
                    keys.append(k)
                    no.append(n)
                    starts.append(a)
                    ends.append(b)
                    kinds.append(how)
                    if with_text:
                        texts.append(t[a:b])
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names)

    return df.select(key, "text", "_limit", "_overlap").mapInArrow(run, schema)
