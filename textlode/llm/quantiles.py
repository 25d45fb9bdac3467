"""Exact percentiles of very large groups by distributed multi-select, and summaries that can be put together.

Groups of few rows are sorted, one window for all of them. In the others, each
round every partition proposes the medians and further local quantiles of the
ranges that are still open; the medians of the proposals, weighted by the
partitions' counts, become pivots; one pass counts the values below, at and
between the pivots; ranges that hold no wanted rank are discarded. A rank that
falls on a pivot is found, and a range that has become small is sorted. Values
are never gathered by group: counting and proposing aggregate inside each
partition first, so a group that holds a third of all rows is spread like any
other. Open ranges are sent to all executors while their number is bounded;
beyond that they are joined by range and salt.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlode.core.session import discard, materialize

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Local quantiles that a partition proposes: its median, and a grid closer together towards the ends.
GRID = (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, *(k / 20 for k in range(2, 19)), 0.93, 0.96, 0.98, 0.99, 0.995, 0.999)
#: A range of so many rows or fewer is sorted within one task instead of being split further.
SMALL_RANGE = 20_000
#: Rounds at most, beyond any table, as each discards at least a quarter of every open range; reaching it is a fault.
MAX_ROUNDS = 200
#: Ranges that are sent to all executors at most, each with some 35 pivots: 15 MB.
MAX_BROADCAST_RANGES = 50_000
#: Parts that the rows of one range are spread over where ranges aren't sent to all.
SALTS = 64


def percentiles(
    df: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float] = PERCENTILES, weight: str | None = None
) -> DataFrame:
    """(groups..., q, n, value): for each group and each q the value at rank ceil(q * n), which is a value of the group.

    Nulls and NaN are no numbers and don't count; a group without a number has
    no rows. Null group keys form a group. Ties and repeated rows count as
    often as they stand; with ``weight`` (a whole number) each row counts so
    often, and rows of a null or smaller than 1 weight don't count. Infinite
    values count as such. An empty table gives an empty result. ``df`` is read
    several times, so write down what is dear to compute or differs by run.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    v = F.col(value).cast("double")
    cand = df.select(F.struct(*groups).alias("g"), F.when(v == 0, F.lit(0.0)).otherwise(v).alias("v"), w.alias("w"))
    cand = cand.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("w") > 0)).withColumn("slot", F.lit(0))
    totals = cand.groupBy("g", "slot").agg(F.sum("w").alias("n"), F.count("*").alias("rows"))
    large = materialize(totals.filter(F.col("rows") > SMALL_RANGE))
    n_large = large.count()
    found = [_small_groups(cand if n_large == 0 else _on_range(cand, large.select("g", "slot"), n_large, "left_anti"), qs)]
    if n_large:
        ranks = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), _rank(q, F.col("n")).alias("r")) for q in qs)))
        live = large.select("g", "slot", "n", "rows", ranks.alias("t")).select("g", "slot", "n", "rows", "t.*")
        for _ in range(MAX_ROUNDS):
            open_ranges = live.select("g", "slot").distinct().count()
            if not open_ranges:
                break
            new_cand, new_live, hits = _round(cand, live, open_ranges)
            small = new_live.filter(F.col("rows") <= SMALL_RANGE)
            found += [hits, _sorted_ranges(new_cand, small)]
            cand, live = new_cand, new_live.filter(F.col("rows") > SMALL_RANGE)
        else:
            raise RuntimeError(f"ranks not found within {MAX_ROUNDS} rounds")
    out = reduce(DataFrame.unionByName, found)
    return out.select(*(F.col("g")[k].alias(k) for k in groups), "q", "n", F.col("v").alias("value"))


def _rank(q: float, n: Column) -> Column:
    return F.greatest(F.ceil(F.lit(float(q)) * n).cast("bigint"), F.lit(1).cast("bigint"))


def _small_groups(cand: DataFrame, qs: Sequence[float]) -> DataFrame:
    """The wanted values of groups of few rows, by sorting each: one shuffle, no join."""
    run = W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    rows = cand.withColumns({"upto": F.sum("w").over(run), "n": F.sum("w").over(W.partitionBy("g"))})
    wanted = F.filter(F.array(*(F.struct(F.lit(float(q)).alias("q"), _rank(q, F.col("n")).alias("r")) for q in qs)), lambda t: (t["r"] <= F.col("upto")) & (t["r"] > F.col("upto") - F.col("w")))
    return rows.select("g", "n", "v", F.inline(wanted)).select("g", "q", "n", "v")


def _on_range(a: DataFrame, b: DataFrame, ranges: int, how: str = "inner") -> DataFrame:
    """Rows of ``a`` joined with their range in ``b`` (one row for each, ``ranges`` at most), null-safe in the group's columns."""
    right = b.withColumnsRenamed({"g": "_g", "slot": "_slot"})
    on = F.col("g").eqNullSafe(F.col("_g")) & (F.col("slot") == F.col("_slot"))
    if ranges <= MAX_BROADCAST_RANGES:
        joined = a.join(F.broadcast(right), on, how)
    else:
        a = a.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = a.join(right.hint("merge"), on & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")
    return joined.drop("_g", "_slot")


def _at_rank(ranks: DataFrame, rows: DataFrame) -> DataFrame:
    """Wanted ranks joined with all rows of their range; both have been cut down before."""
    right = rows.withColumnsRenamed({"g": "_g", "slot": "_slot"})
    return ranks.join(right, F.col("g").eqNullSafe(F.col("_g")) & (F.col("slot") == F.col("_slot"))).drop("_g", "_slot")


def _sorted_ranges(cand: DataFrame, small: DataFrame) -> DataFrame:
    """The wanted values of ranges of at most SMALL_RANGE rows, by sorting each."""
    w = W.partitionBy("g", "slot").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    rows = cand.withColumn("upto", F.sum("w").over(w)).select("g", "slot", "v", "w", "upto")
    hit = _at_rank(small.select("g", "slot", "q", "n", "r"), rows)
    return hit.filter((F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("w"))).select("g", "q", "n", "v")


def _round(cand: DataFrame, live: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over ``ranges`` open ranges: the rows and ranks that are left, and the values found."""
    cand = _on_range(cand, live.select("g", "slot").distinct(), ranges)
    proposals = cand.groupBy(F.spark_partition_id().alias("part"), "g", "slot").agg(
        F.percentile_approx("v", [*GRID], 400).alias("p"), F.count("*").alias("rows")
    )
    medians = (
        proposals.select("g", "slot", "rows", F.posexplode("p").alias("k", "p"))
        .groupBy("g", "slot", "k")
        .agg(F.percentile("p", F.lit(0.5), F.col("rows")).alias("p"))
    )
    pivots = materialize(medians.groupBy("g", "slot").agg(F.array_sort(F.array_distinct(F.collect_list("p"))).alias("pivots")))
    below = F.size(F.filter("pivots", lambda p: p < F.col("v")))
    placed = _on_range(cand, pivots, ranges).withColumn("below", below)
    # even: between two pivots, odd: at a pivot
    placed = placed.withColumn("b", 2 * F.col("below") + (F.try_element_at("pivots", F.col("below") + 1).eqNullSafe(F.col("v"))).cast("int"))
    counts = placed.groupBy("g", "slot", "b").agg(F.sum("w").alias("c"), F.count("*").alias("rows"))
    w = W.partitionBy("g", "slot").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    counts = materialize(counts.withColumn("upto", F.sum("c").over(w)))
    hit = _at_rank(live.drop("rows"), counts)
    hit = hit.filter((F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("c")))
    hits = _on_range(hit.filter(F.col("b") % 2 == 1), pivots, ranges).select(
        "g", "q", "n", F.element_at("pivots", ((F.col("b") + 1) / 2).cast("int")).alias("v")
    )
    rest = hit.filter(F.col("b") % 2 == 0)
    slots = rest.select("g", "slot", "b").distinct().withColumn("new", F.dense_rank().over(W.partitionBy("g").orderBy("slot", "b")))
    # the new ranges of each old one, so that one lookup moves a row
    moved = materialize(slots.groupBy("g", "slot").agg(F.map_from_entries(F.collect_list(F.struct("b", "new"))).alias("to")))
    to = F.try_element_at("to", F.col("b"))
    new_live = _on_range(rest, moved, ranges).select("g", to.alias("slot"), "n", "rows", "q", (F.col("r") - (F.col("upto") - F.col("c"))).alias("r"))
    new_cand = _on_range(placed.select("g", "slot", "v", "w", "b"), moved, ranges).filter(to.isNotNull()).select("g", "v", "w", to.alias("slot"))
    out = materialize(new_cand), materialize(new_live), materialize(hits)
    discard(pivots, counts, moved)
    return out


# Summaries

#: The bucket of infinite values.
INFINITE = 2**31 - 1


def summarize(df: DataFrame, groups: Sequence[str], value: str, alpha: float = 0.005) -> DataFrame:
    """(groups..., bucket, c): counts by logarithmic bucket, a summary of any part of the rows.

    Two summaries are put together by adding the counts of equal buckets, in any
    order, without further error. A percentile read from a summary differs from
    the exact one by at most ``alpha`` of it. Values nearer to zero than 1e-9
    count as zero; bucket keys of negative values are negative. Infinite values
    have buckets of their own, nulls and NaN are left out. A row stands for a group
    and bucket, so its size is bounded by log(range) / alpha for each group.
    """
    v = F.col(value).cast("double")
    gamma = (1 + alpha) / (1 - alpha)
    level = F.ceil(F.log(F.abs(v) / F.lit(1e-9)) / F.lit(math.log(gamma))).cast("int")
    level = F.when(F.abs(v) == float("inf"), F.lit(INFINITE)).otherwise(level)
    bucket = F.when(F.abs(v) <= 1e-9, F.lit(0)).when(v > 0, level).otherwise(-level)
    numbers = df.filter(v.isNotNull() & ~F.isnan(v))
    return numbers.groupBy(*groups, bucket.alias("bucket")).agg(F.count("*").alias("c"))


def merge_summaries(summaries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Summaries of several parts or days put together for coarser groups."""
    return summaries.groupBy(*groups, "bucket").agg(F.sum("c").alias("c"))


def summary_percentiles(summary: DataFrame, groups: Sequence[str], qs: Sequence[float] = PERCENTILES, alpha: float = 0.005) -> DataFrame:
    """Percentiles of summarised values by the same multi-select, each bucket counting as often as it holds values."""
    gamma = (1 + alpha) / (1 - alpha)
    size = F.lit(1e-9) * F.pow(F.lit(gamma), F.abs("bucket")) * F.lit(2 / (gamma + 1))
    size = F.when(F.abs("bucket") == INFINITE, F.lit(float("inf"))).otherwise(size)
    middle = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.signum(F.col("bucket").cast("double")) * size)
    return percentiles(summary.withColumn("_middle", middle), groups, "_middle", qs, "c")
