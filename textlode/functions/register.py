"""The operators as SQL functions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from textlode.operators.align import ALIGNMENT_TYPE, align
from textlode.operators.tokens import Sentences, chunk_ranges, tokenize


@udtf(returnType="chunk_no int, char_offset int, chunk_text string")
class ChunkText:
    """``LATERAL chunk_text(text, limit)``: the chunks of a text."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, int, str]]:
        tokens = tokenize(text or "")
        for n, (a, b) in enumerate(chunk_ranges(tokens, Sentences(text or "", tokens), max(1, limit or 1000))):
            yield n, tokens[a].start_pos, text[tokens[a].start_pos : tokens[b - 1].end_pos]


@udtf(returnType="idx int, token_type int, start_pos int, end_pos int, after_newline boolean")
class TokenizeText:
    """``LATERAL tokenize_text(text)``: the tokens of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, int, bool]]:
        for t in tokenize(text or ""):
            yield t.idx, t.token_type, t.start_pos, t.end_pos, t.after_newline


def register(spark: SparkSession) -> None:
    """Make chunk_text, tokenize_text and align_text known to a session's SQL."""

    @F.pandas_udf(ALIGNMENT_TYPE)
    def align_text(source: pd.Series, excerpt: pd.Series) -> pd.DataFrame:
        hits = [align(s, x) if s is not None and x is not None else None for s, x in zip(source, excerpt, strict=True)]
        return pd.DataFrame([(h.status, h.start, h.end, h.text, h.score) if h else (None,) * 5 for h in hits], columns=["status", "start", "end", "text", "score"])

    spark.udf.register("align_text", align_text)
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("tokenize_text", TokenizeText)
