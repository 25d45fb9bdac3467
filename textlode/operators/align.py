"""Alignment of extracted texts to spans of their source.

Exact and case-insensitive hits, the bulk, are found by column expressions; only
the misses go through one Arrow UDF for the normalised and fuzzy searches, since
Spark evaluates a Python UDF for every row even inside a CASE.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.core.jstext import js_trim, strip

FUZZY_THRESHOLD = 0.75
LESSER_SCORE = 0.95
#: Words that a fuzzy window may be shorter or longer than the excerpt.
WINDOW_SLACK = 2

_WORD = re.compile("[A-Za-z0-9]+")
_DROP = re.compile("[^A-Za-z0-9]+")


@dataclass(frozen=True)
class Alignment:
    status: str
    start: int
    end: int
    text: str
    score: float


@dataclass(frozen=True)
class AlignOptions:
    fuzzy: bool = True
    threshold: float = FUZZY_THRESHOLD
    lesser: bool = True

    def __post_init__(self) -> None:
        t = self.threshold
        if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t):
            raise TypeError("fuzzy_alignment_threshold must be a finite number.")
        if not 0 <= t <= 1:
            raise TypeError("fuzzy_alignment_threshold must be between 0 and 1.")


def fold_word(w: str) -> str:
    """Lower case without a plural s."""
    w = w.lower()
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w


def overlap(a: Counter, n_a: int, words: list[str]) -> float:
    """Multiset overlap over the longer length."""
    if not n_a or not words:
        return 0.0
    return (a & Counter(words)).total() / max(n_a, len(words))


def _squeeze(s: str) -> str:
    return _DROP.sub("", s).lower()


def best_window(source: str, excerpt: str, threshold: float) -> tuple[int, int, float] | None:
    """(start, end, score) of the run of words that shares most with the excerpt: the earliest, then shortest of the best.

    Overlap counts slide along the words for each window length, so the work is
    linear in the words of the source, not in words times length of the excerpt.
    """
    words = [(fold_word(m[0]), m.start(), m.end()) for m in _WORD.finditer(source)]
    want = Counter(fold_word(w) for w in _WORD.findall(excerpt))
    n = want.total()
    if not words or not n:
        return None
    best: tuple[float, int, int] | None = None  # (-score, start, length)
    for length in range(max(1, n - WINDOW_SLACK), min(len(words), n + WINDOW_SLACK) + 1):
        longer = max(n, length)
        have: Counter = Counter()
        shared = 0
        for k, (w, _, _) in enumerate(words):
            have[w] += 1
            if have[w] <= want[w]:
                shared += 1
            if k >= length:
                old = words[k - length][0]
                if have[old] <= want[old]:
                    shared -= 1
                have[old] -= 1
            if k >= length - 1:
                score = shared / longer
                key = (-score, k - length + 1, length)
                if score >= threshold and (best is None or key < best):
                    best = key
    if best is None:
        return None
    score, a, length = best
    return words[a][1], words[a + length - 1][2], -score


def by_hint(source: str, excerpt: str, a: int, b: int, o: AlignOptions) -> Alignment | None:
    if not 0 <= a < b <= len(source):
        return None
    there = source[a:b]
    if there == excerpt or o.lesser and there.lower() == excerpt.lower():
        return Alignment("exact", a, b, there, 1.0)
    if o.lesser and _squeeze(there) == _squeeze(excerpt):
        return Alignment("lesser", a, b, there, LESSER_SCORE)
    if o.fuzzy:
        words = [fold_word(w) for w in _WORD.findall(excerpt)]
        score = overlap(Counter(words), len(words), [fold_word(w) for w in _WORD.findall(there)])
        if score >= o.threshold:
            return Alignment("fuzzy", a, b, there, score)
    return None


def by_letters(source: str, excerpt: str) -> Alignment | None:
    """The first stretch with the same ASCII letters and digits, case and all other characters aside."""
    want = _squeeze(excerpt)
    if not want:
        return None
    kept = [k for k, c in enumerate(source) if c.isascii() and c.isalnum()]
    at = "".join(source[k] for k in kept).lower().find(want)
    if at < 0:
        return None
    a, b = kept[at], kept[at + len(want) - 1] + 1
    return Alignment("lesser", a, b, source[a:b], LESSER_SCORE)


def align(source: str, excerpt: str, hint: tuple[int, int] | None = None, options: AlignOptions = AlignOptions()) -> Alignment:
    """Where an excerpt stands in its source: by hint, exactly, case aside, by letters and digits, by shared words; the first that finds it."""
    x = strip(excerpt)
    if not x:
        return Alignment("fuzzy", -1, -1, "", 0.0)
    if hint and (hit := by_hint(source, x, *hint, options)):
        return hit
    at = source.find(x)
    if at < 0:
        at = source.lower().find(x.lower())
    if at >= 0:
        return Alignment("exact", at, at + len(x), source[at : at + len(x)], 1.0)
    if options.lesser and (hit := by_letters(source, x)):
        return hit
    if options.fuzzy and (w := best_window(source, x, options.threshold)):
        return Alignment("fuzzy", w[0], w[1], source[w[0] : w[1]], w[2])
    return Alignment("fuzzy", -1, -1, x, 0.0)


ALIGNMENT_TYPE = "struct<status:string,start:int,end:int,text:string,score:double>"


def exact_span(source: Column, excerpt: Column) -> Column:
    """The alignment struct where the trimmed excerpt stands in the source as it is or case aside, else null; in the JVM."""
    x = js_trim(excerpt)
    at = F.position(x, source) - 1
    ci = F.position(F.lower(x), F.lower(source)) - 1
    found = F.when(at >= 0, at).when(ci >= 0, ci)
    span = F.struct(
        F.lit("exact").alias("status"),
        found.cast("int").alias("start"),
        (found + F.length(x)).cast("int").alias("end"),
        F.substring(source, found + 1, F.length(x)).alias("text"),
        F.lit(1.0).alias("score"),
    )
    return F.when((F.length(x) > 0) & found.isNotNull(), span)


def align_columns(df: DataFrame, source: str, excerpt: str, hint_start: str | None = None, hint_end: str | None = None, options: AlignOptions = AlignOptions(), out: str = "alignment") -> DataFrame:
    """``df`` with an alignment struct in ``out``; null where source or excerpt is null.

    The table is read once. Rows with a usable hint and rows without an exact hit
    are aligned in Arrow batches that get nothing but their texts; of the others
    only nulls leave the JVM.
    """
    a, b = (F.col(hint_start), F.col(hint_end)) if hint_start and hint_end else (F.lit(None).cast("int"), F.lit(None).cast("int"))
    has_hint = F.coalesce((a >= 0) & (b > a) & (b <= F.length(source)), F.lit(False))
    present = F.col(source).isNotNull() & F.col(excerpt).isNotNull()
    ready = df.withColumn("_exact", F.when(present & ~has_hint, exact_span(F.col(source), F.col(excerpt))))
    open_ = present & F.col("_exact").isNull()

    @F.pandas_udf(ALIGNMENT_TYPE)
    def search(sources: pd.Series, excerpts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        hits = []
        for s, x, h0, h1 in zip(sources, excerpts, starts, ends, strict=True):
            r = None if s is None else align(s, x, None if pd.isna(h0) or pd.isna(h1) else (int(h0), int(h1)), options)
            hits.append((None,) * 5 if r is None else (r.status, r.start, r.end, r.text, r.score))
        out = pd.DataFrame(hits, columns=["status", "start", "end", "text", "score"])
        return out.astype({"start": "Int32", "end": "Int32"})

    found = search(F.when(open_, F.col(source)), F.when(open_, F.col(excerpt)), F.when(open_, a).cast("int"), F.when(open_, b).cast("int"))
    return ready.withColumn("_found", found).withColumn(out, F.when(open_, F.col("_found")).otherwise(F.col("_exact"))).drop("_exact", "_found")
