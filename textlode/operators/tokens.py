"""Tokens, sentence ranges and size-bounded chunks of documents.

Word statistics stay in the JVM (`token_tiles`). Offsets need the running
position within one text, so they're taken in Arrow batches: one pass over a
text gives its tokens, sentence ends and chunks as arrays, without a shuffle.
Offsets are code points and intervals half-open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass
from secrets import token_hex

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlode.core.errors import InvalidTokenIntervalError, SentenceRangeError, TokenUtilError
from textlode.core.jstext import PY_WS, WS_CLASS, blank_to_null, js_trim, strip
from textlode.core.session import materialize

WORD, NUMBER, PUNCTUATION = 0, 1, 2

_INNER_WS = PY_WS[1:-1]
_TOKEN = regex.compile(rf"([\p{{L}}\p{{M}}]+)|(\p{{N}}+)|([^\p{{L}}\p{{N}}{_INNER_WS}]|_)\3*")
# The sentence rule's stops, closers and abbreviations.
_STOP = regex.compile("[.?!。！？।][\"'”’»)\\]}]*\\Z")
CLOSERS = frozenset("\"'”’»)]}")
ABBREVIATIONS = frozenset(("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St."))


@dataclass(frozen=True)
class Token:
    idx: int
    token_type: int
    start_pos: int
    end_pos: int
    after_newline: bool


def tokenize(text: str) -> list[Token]:
    """Runs of letters and marks, runs of digits, and runs of one repeated symbol; white space belongs to no token."""
    out: list[Token] = []
    end = 0
    for k, m in enumerate(_TOKEN.finditer(text)):
        a, b = m.span()
        broken = k > 0 and any(c in "\r\n" for c in text[end:a])
        out.append(Token(k, WORD if m.lastindex == 1 else NUMBER if m.lastindex == 2 else PUNCTUATION, a, b, broken))
        end = b
    return out


def tokens_text(text: str, tokens: Sequence[Token], start: int, end: int) -> str:
    """The text from the first to the last token of an interval; empty for an empty one."""
    if start == end:
        return ""
    if start < 0 or end > len(tokens) or start > end:
        raise InvalidTokenIntervalError(f"Invalid token interval [{start}, {end}) of {len(tokens)} tokens.")
    return text[tokens[start].start_pos : tokens[end - 1].end_pos]


def token_interval(start: int, end: int) -> tuple[int, int]:
    if start < 0:
        raise IndexError(f"Start index {start} must be non-negative.")
    if start >= end:
        raise IndexError(f"Start index {start} must be < end index {end}.")
    return start, end


def interval_text(text: str, tokens: Sequence[Token], start: int, end: int) -> str:
    token_interval(max(start, 0), end)
    out = tokens_text(text, tokens, start, end)
    if text and not out:
        raise TokenUtilError("A token interval of a text gave no text.")
    return out


def char_interval(tokens: Sequence[Token], start: int, end: int) -> tuple[int, int]:
    token_interval(start, end)
    if end > len(tokens):
        raise IndexError(f"Token interval [{start}, {end}) is out of bounds.")
    return tokens[start].start_pos, tokens[end - 1].end_pos


def sanitize(text: str) -> str:
    """White space collapsed to single blanks; an empty outcome is an error."""
    out = regex.sub(f"{PY_WS}+", " ", strip(text))
    if not out:
        raise ValueError("Sanitized text is empty.")
    return out


class Sentences:
    """Sentence ends of one text's tokens under the sentence rule, found once for all starting points.

    ``marks`` holds the tokens at which a sentence ends if it began at or before
    them, ``ends`` the exclusive end each of them leads to.
    """

    def __init__(self, text: str, tokens: Sequence[Token], abbreviations: Collection[str] = ABBREVIATIONS):
        words = [text[t.start_pos : t.end_pos] for t in tokens]
        n = self.n = len(tokens)
        self.marks: list[int] = []
        self.ends: list[int] = []
        closed = n  # first index behind the run of closers that starts behind the current token
        for k in range(n - 1, -1, -1):
            t = tokens[k]
            nxt = k + 1
            if nxt < n and not (tokens[nxt].token_type == PUNCTUATION and words[nxt] in CLOSERS):
                closed = nxt
            stop = t.token_type == PUNCTUATION and _STOP.search(words[k]) and not (k > 0 and words[k - 1] + words[k] in abbreviations)
            if stop:
                self.marks.append(k)
                self.ends.append(closed)
            elif nxt < n and tokens[nxt].after_newline:
                c = words[nxt][0]
                if not (c.lower() == c and c.upper() != c):
                    self.marks.append(k)
                    self.ends.append(nxt)
        self.marks.reverse()
        self.ends.reverse()

    def end_from(self, start: int) -> int:
        """The exclusive end of the sentence that starts at a token."""
        if self.n == 0:
            return 0
        if not 0 <= start < self.n:
            raise SentenceRangeError(f"start {start} is out of range for {self.n} tokens")
        k = bisect_left(self.marks, start)
        return self.ends[k] if k < len(self.marks) else self.n

    def ranges(self, start: int = 0) -> Iterator[tuple[int, int]]:
        if not 0 <= start <= self.n:
            raise IndexError(f"Token position {start} is out of range for {self.n} tokens.")
        while start < self.n:
            end = self.end_from(start)
            yield start, end
            start = end


def chunk_ranges(tokens: Sequence[Token], sentences: Sentences, limit: int) -> Iterator[tuple[int, int]]:
    """Token intervals of the chunks: whole sentences packed greedily up to ``limit`` characters.

    A sentence longer than the limit is cut at its last line start that fits,
    else at the last token that fits; its tail is never packed with what follows.
    A single token longer than the limit is a chunk of its own.
    """
    ends = [t.end_pos for t in tokens]
    lines = [t.idx for t in tokens if t.after_newline]
    n, at, broken = len(tokens), 0, False
    while at < n:
        sentence = sentences.end_from(at)
        fits = bisect_right(ends, tokens[at].start_pos + limit)  # the first token that reaches beyond the limit
        if fits <= at:
            yield at, at + 1
            broken, at = at + 1 < sentence, at + 1
        elif fits < sentence:
            k = bisect_right(lines, fits) - 1
            cut = lines[k] if k >= 0 and lines[k] > at else fits
            yield at, cut
            broken, at = True, cut
        elif broken:
            yield at, sentence
            broken, at = False, sentence
        else:
            end = sentence
            while end < n and (nxt := sentences.end_from(end)) <= fits:
                end = nxt
            yield at, end
            at = end


Tokenizer = Callable[[str], list[Token]]
TOKEN_TYPE = "struct<idx:int,token_type:int,start_pos:int,end_pos:int,after_newline:boolean>"


def _flat_map(df: DataFrame, keys: str | Sequence[str], columns: Sequence[str], schema: str, names: Sequence[str], types: Sequence[pa.DataType], rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """One output row per tuple that ``rows`` yields for the columns of an input row, the keys carried along."""
    kept = [keys] if isinstance(keys, str) else list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], [[] for _ in names]
            for k, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(kept) :]), strict=True)):
                for row in rows(*values):
                    take.append(k)
                    for cell, x in zip(out, row, strict=True):
                        cell.append(x)
            ids = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(ids) for k in range(len(kept))), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*kept, *names])

    kinds = dict(df.dtypes)
    return df.select(*kept, *columns).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in kept) + f", {schema}")


def tokens_of(df: DataFrame, key: str, text: str = "text", tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(key, idx, token_type, start_pos, end_pos, after_newline) of all tokens; null texts have none."""

    def rows(t: str | None) -> Iterator[tuple]:
        return ((x.idx, x.token_type, x.start_pos, x.end_pos, x.after_newline) for x in (tokenizer(t) if t else ()))

    names = ("idx", "token_type", "start_pos", "end_pos", "after_newline")
    return _flat_map(df, key, [text], "idx int, token_type int, start_pos int, end_pos int, after_newline boolean", names, (pa.int32(),) * 4 + (pa.bool_(),), rows)


def sentences_of(df: DataFrame, key: str, text: str = "text", tokenizer: Tokenizer = tokenize, abbreviations: Collection[str] = ABBREVIATIONS) -> DataFrame:
    """(key, sentence_no, start_tok, end_tok, start_pos, end_pos) under the sentence rule."""

    def rows(t: str | None) -> Iterator[tuple]:
        tokens = tokenizer(t) if t else []
        for n, (a, b) in enumerate(Sentences(t or "", tokens, abbreviations).ranges()):
            yield n, a, b, tokens[a].start_pos, tokens[b - 1].end_pos

    names = ("sentence_no", "start_tok", "end_tok", "start_pos", "end_pos")
    return _flat_map(df, key, [text], ", ".join(f"{n} int" for n in names), names, (pa.int32(),) * 5, rows)


def chunks_of(df: DataFrame, key: str, limit: int | Column = 1000, text: str = "text", tokenizer: Tokenizer = tokenize, keep: Sequence[str] = (), tail_chars: int | None = None) -> DataFrame:
    """(key, keep..., chunk_no, start_tok, end_tok, char_offset, chunk_text[, chunk_tail]).

    ``limit`` may be a column. A text without tokens (empty or blank) is one
    chunk of itself with no tokens; a null text has none. With ``tail_chars``
    ``chunk_tail`` is the end of the chunk before within the text, without white
    space at its ends; null where there's none.
    """
    source = df.select(key, *keep, text, (limit if isinstance(limit, Column) else F.lit(limit)).cast("int").alias("_limit"))

    def chunks(t: str | None, most: int | None) -> Iterator[tuple]:
        if t is None:
            return
        tokens = tokenizer(t)
        if not tokens:
            yield 0, 0, 0, 0, t
        for n, (a, b) in enumerate(chunk_ranges(tokens, Sentences(t, tokens), max(1, most if most is not None else 1000))):
            yield n, a, b, tokens[a].start_pos, t[tokens[a].start_pos : tokens[b - 1].end_pos]

    def with_tails(t: str | None, most: int | None) -> Iterator[tuple]:
        tail = None
        for row in chunks(t, most):
            yield *row, tail
            tail = strip(row[4][-tail_chars:]) or None

    names = ["chunk_no", "start_tok", "end_tok", "char_offset", "chunk_text"]
    schema, types = "chunk_no int, start_tok int, end_tok int, char_offset int, chunk_text string", (pa.int32(),) * 4 + (pa.string(),)
    if tail_chars:
        return _flat_map(source, [key, *keep], [text, "_limit"], f"{schema}, chunk_tail string", [*names, "chunk_tail"], (*types, pa.string()), with_tails)
    return _flat_map(source, [key, *keep], [text, "_limit"], schema, names, types, chunks)


def chunk_views(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``sanitized_text`` (blanks collapsed; null for a blank chunk) and the span of each in its document, ``start_pos`` and ``end_pos``."""
    flat = js_trim(F.regexp_replace("chunk_text", f"[{WS_CLASS}]+", " "))
    return chunks.withColumns({"sanitized_text": F.when(F.length(flat) > 0, flat), "start_pos": F.col("char_offset"), "end_pos": (F.col("char_offset") + F.length("chunk_text")).cast("int")})


def document_id(text: Column | str) -> Column:
    """An id for a document that has none: ``doc_`` and eight hexadecimal digits of its text's hash, so that a retry gives the same."""
    return F.concat(F.lit("doc_"), F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(text), 32))), 8, "0"))


def random_document_id() -> str:
    """The same form, at random, for documents made on the driver."""
    return f"doc_{token_hex(4)}"


def numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with the rank of each row, from 0, in a total order of the table.

    Rows are numbered per range partition and offset by the counts before it, so
    that no single task sees all rows.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = ranged.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return rows.join(before, "_part").withColumn(out, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def batches_of(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """``df`` with ``batch_no``: consecutive batches of ``size`` rows in a given order."""
    if size <= 0:
        raise ValueError(f"batch size must be > 0, not {size}")
    return numbered(df, order, "_rank").withColumn("batch_no", F.floor(F.col("_rank") / size).cast("bigint")).drop("_rank")


def token_tiles(text: Column | str) -> Column:
    """Tokens and white space of a text as an array that joins to the text again, in the JVM."""
    return F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{M}}]+|\p{{N}}+|[{WS_CLASS}]+|([^\p{{L}}\p{{N}}{WS_CLASS}]|_)\1*"), F.lit(0))


def token_counts(text: Column | str) -> dict[str, Column]:
    """Counts of word, number and symbol tokens, in the JVM; null for a null text."""
    t = F.col(text) if isinstance(text, str) else text
    return {
        "n_words": F.regexp_count(t, F.lit(r"[\p{L}\p{M}]+")),
        "n_numbers": F.regexp_count(t, F.lit(r"\p{N}+")),
        "n_symbols": F.regexp_count(t, F.lit(rf"(?:([^\p{{L}}\p{{M}}\p{{N}}{WS_CLASS}])\1*)")),
    }


def with_context(chunks: DataFrame, key: str, order: str, text: str, window_chars: int | None, additional: Column | None = None) -> DataFrame:
    """``chunks`` with ``chunk_context``: the document's own context, then the end of the chunk before within the document; null where there's neither."""
    prev = F.lag(text).over(W.partitionBy(key).orderBy(order))
    tail = F.lit(None).cast("string")
    if window_chars is not None and window_chars > 0:
        last = F.regexp_replace(F.right(prev, F.lit(window_chars)), rf"^[{WS_CLASS}]++|[{WS_CLASS}]++\z", "")
        tail = F.when(F.length(last) > 0, F.concat(F.lit("Previous chunk context:\n"), last))
    return chunks.withColumn("chunk_context", compose_context(additional if additional is not None else F.lit(None).cast("string"), tail))


def compose_context(*parts: Column) -> Column:
    """The parts that aren't blank, an empty line between; null if there's none."""
    kept = [blank_to_null(p) for p in parts]
    joined = F.concat_ws("\n\n", *kept)
    return F.when(F.coalesce(*kept).isNotNull(), joined)
