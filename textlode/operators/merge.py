"""Merging the extractions of several passes: keyed preference, and spans of earlier passes before those of later ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.core.session import materialize

#: Characters in a bucket of the range join, as many as a whole number has bits. A span falls into each bucket it touches.
BUCKET = 64
KEY = ("document_id", "label", "start_pos", "end_pos", "text")


def normalize_status(c: Column | str) -> Column:
    """exact, lesser or fuzzy; core names as their kin, anything else and null as fuzzy."""
    s = F.col(c) if isinstance(c, str) else c
    return F.when(s.isin("exact", "match_exact"), "exact").when(s.isin("lesser", "match_lesser", "match_greater"), "lesser").otherwise("fuzzy")


def preference(seq: str) -> Column:
    """Orders records of one key, the preferred first: alignment, confidence, earlier pass, first seen."""
    rank = F.when(F.col("alignment_status") == "exact", 3).when(F.col("alignment_status") == "lesser", 2).when(F.col("alignment_status") == "fuzzy", 1).otherwise(0)
    sure = F.coalesce(F.nanvl(F.col("confidence"), F.lit(0.0)), F.lit(0.0))
    return F.struct((-rank).alias("a"), (-sure).alias("b"), F.coalesce("pass", F.lit(2**31 - 1)).alias("c"), F.col(seq).alias("d"))


def dedup(df: DataFrame, seq: str) -> DataFrame:
    """One row for each key (document, label, span and text): the preferred one, by aggregation inside partitions first.

    ``seq`` orders rows that are equal otherwise. Nulls in a key are one value.
    """
    rest = [c for c in df.columns if c not in KEY]
    best = df.groupBy(*KEY).agg(F.min_by(F.struct(*rest), preference(seq)).alias("_best"))
    return best.select(*(F.col(c) if c in KEY else F.col("_best")[c].alias(c) for c in df.columns))


def has_span() -> Column:
    return (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos"))


def _covered(df: DataFrame) -> DataFrame:
    """(document_id, start_pos, end_pos, bucket, mask): the characters of each span as bits of the buckets that it touches."""
    bucket = F.explode(F.sequence(F.floor(F.col("start_pos") / BUCKET), F.floor((F.col("end_pos") - 1) / BUCKET)))
    parts = df.filter(has_span()).select("document_id", "start_pos", "end_pos", bucket.alias("bucket"))
    low = F.greatest(F.col("start_pos") - F.col("bucket") * BUCKET, F.lit(0)).cast("int")
    high = F.least(F.col("end_pos") - F.col("bucket") * BUCKET, F.lit(BUCKET)).cast("int")
    ones = F.lit(-1).cast("bigint")
    mask = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(BUCKET) - high))
    return parts.withColumn("mask", mask)


def without_overlaps(new: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``new`` whose span overlaps no span of ``kept`` in the same document; rows without a span stay.

    A range anti-join as an equi-join on (document, bucket). What ``kept`` covers
    of a bucket is one bit mask, so a bucket is one row whatever spans lie in it,
    and a document with very many spans is spread by bucket.
    """
    cover = _covered(kept).groupBy("document_id", "bucket").agg(F.bit_or("mask").alias("cover"))
    spans = _covered(new.select("document_id", "start_pos", "end_pos").distinct())
    hit = spans.join(cover, ["document_id", "bucket"]).filter(F.col("mask").bitwiseAND(F.col("cover")) != 0)
    return new.join(hit.select("document_id", "start_pos", "end_pos").distinct(), ["document_id", "start_pos", "end_pos"], "left_anti").select(*new.columns)


def merge_passes(df: DataFrame, seq: str, passes: Iterable[int] | None = None) -> DataFrame:
    """The extractions that stay after all passes.

    Pass by pass: rows that overlap a kept span of an earlier pass go, then of
    each key the preferred row stays. Only kept rows suppress others. Passes are
    few, so the loop is on the driver; what is kept is written to the shared
    folder after each but the last. Rows of a null pass count as the last pass.
    """
    df = df.withColumn("_pass", F.coalesce("pass", F.lit(2**31 - 1)))
    passes = None if passes is None else list(passes)
    if passes is None or len(passes) > 1:
        df = materialize(df)
    if passes is None:
        passes = sorted(r["_pass"] for r in df.select("_pass").distinct().collect())
    kept: DataFrame | None = None
    for p in passes:
        new = dedup(df.filter(F.col("_pass") == p).drop("_pass"), seq)
        kept = new if kept is None else dedup(kept.unionByName(without_overlaps(new, kept)), seq)
        kept = kept if p == passes[-1] else materialize(kept)
    return kept if kept is not None else df.drop("_pass").limit(0)


def ordered(df: DataFrame, seq: str) -> DataFrame:
    """Within documents by start, end, label in dictionary order, then first seen."""
    return df.orderBy("document_id", "start_pos", "end_pos", F.collate("label", "UNICODE"), seq)


def by_document(documents: DataFrame, extractions: DataFrame, seq: str, key: str = "document_id") -> DataFrame:
    """One row for each document with its extractions as a sorted array, empty where it has none."""
    fields = [c for c in extractions.columns if c not in (key, seq)]
    item = F.struct("start_pos", "end_pos", F.collate("label", "UNICODE").alias("_label"), F.col(seq).alias("_seq"), F.struct(*fields).alias("x"))
    grouped = extractions.groupBy(F.col(key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]).alias("extractions"))
    joined = documents.join(grouped, F.col(key) == F.col("_key"), "left").drop("_key")
    kind = dict(grouped.dtypes)["extractions"]
    return joined.withColumn("extractions", F.coalesce("extractions", F.array().cast(kind)))
