"""Sources combined to target shares of the total size, small ones repeated a capped number of times.

Weights: source shares are exponentiated towards their targets and the exponent
is bisected to the last point that the repetition limits (or a wanted entropy)
allow. Realisation: a source that has to give more than it holds is read in
whole epochs and a last part of one; each epoch is a permutation of its own, by
hash, and the last part ends where its budget is used up. That place is found
from token sums of hash buckets, then within one bucket, so no source is ever
sorted as a whole and a source that holds a third of all rows is spread like any
other. Blocks of the mixture hold every source in its weight, its documents
permuted within the block.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlode.core.session import materialize
from textlode.llm.bpe import BYTE_BPE, TOKENIZER_DIR, count_tokens

#: Documents in a hash bucket on average, the largest unit that one task sorts.
BUCKET_DOCS = 20_000
#: Rows of the target table at most: it's a fixed table of settings that the driver reads.
MAX_TARGETS = 100_000


def temperature_shares(sizes: Mapping[str, float], exponent: float) -> dict[str, float]:
    """Normalised shares of sizes raised to an exponent: 1 keeps them, 0 makes them even. Empty sources get nothing."""
    w = {k: math.exp(exponent * math.log(v)) for k, v in sizes.items() if v > 0}
    total = sum(w.values())
    return {k: (w[k] / total if k in w else 0.0) for k in sizes}


def entropy(shares: Mapping[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect_exponent(ok, low: float, high: float, rounds: int = 60) -> float:
    """The largest exponent in [low, high] for which ``ok`` holds, ``low`` if none; ok must hold below and fail above."""
    if ok(high):
        return high
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def exponent_for_entropy(sizes: Mapping[str, float], wanted: float) -> float:
    """The exponent in [0, 1] at which the shares' entropy comes to ``wanted`` (the nearest end where it's out of reach)."""
    return bisect_exponent(lambda a: entropy(temperature_shares(sizes, a)) >= wanted, 0.0, 1.0)


@dataclass(frozen=True)
class Plan:
    """What one mix takes: the exponent reached (1: the targets themselves), and tokens for each source."""

    exponent: float
    total: float
    tokens: dict[str, float]


def plan_mix(sizes: Mapping[str, float], targets: Mapping[str, float], repeats: Mapping[str, int], total: float | None = None) -> Plan:
    """Weights and budget of a mix.

    Without ``total`` it's the largest size at which every source that has text
    gives its target share within its repeats. With a ``total`` too large for
    that, shares move from the targets towards the sources' own sizes until the
    limits hold; where even those can't give it, the total shrinks. Targets are
    normalised over the sources that have text; the others give nothing.
    """
    have = {k: s for k, s in sizes.items() if s > 0 and targets.get(k, 0) > 0 and repeats.get(k, 0) > 0}
    if not have:
        return Plan(1.0, 0.0, {k: 0.0 for k in targets})
    room = {k: have[k] * repeats[k] for k in have}
    norm = sum(targets[k] for k in have)
    target = {k: targets[k] / norm for k in have}
    size = sum(have.values())

    def shares(a: float) -> dict[str, float]:
        w = {k: math.exp((1 - a) * math.log(have[k] / size) + a * math.log(target[k])) for k in have}
        z = sum(w.values())
        return {k: x / z for k, x in w.items()}

    if total is None:
        total = min(room[k] / target[k] for k in have)
    fits = lambda a: all(p * total <= room[k] * (1 + 1e-12) for k, p in shares(a).items())
    a = bisect_exponent(fits, 0.0, 1.0)
    p = shares(a)
    total = min(total, *(room[k] / p[k] for k in have))
    return Plan(a, total, {k: (min(p[k] * total, room[k]) if k in p else 0.0) for k in targets})


def token_sizes(documents: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{BYTE_BPE}") -> DataFrame:
    """(doc_id, source, n_tokens) of each document; null and empty texts have no tokens."""
    rows = documents.select(F.struct("doc_id", "source").alias("_d"), "text")
    return count_tokens(rows, "_d", "text", "n_tokens", vocabulary).select("_d.doc_id", "_d.source", "n_tokens")


def held_tokens(sizes: DataFrame, targets: DataFrame) -> dict[str, float]:
    """The tokens that the sources of each mix hold together, each document once."""
    named = targets.filter("mix_name is not null and target_share > 0 and max_repeats > 0").select("mix_name", "source").distinct()
    held = sizes.join(F.broadcast(named.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    return {r["mix_name"]: float(r["n"] or 0) for r in named.join(held, "source").groupBy("mix_name").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Mixture:
    rows: DataFrame
    shares: DataFrame


def mix_sources(sizes: DataFrame, targets: DataFrame, total: Mapping[str, float] | None = None, seed: int = 17, blocks: int = 64) -> Mixture:
    """The mixtures of all mixes in ``targets`` (mix_name, source, target_share, max_repeats) over ``sizes`` (doc_id, source, n_tokens).

    ``rows``: (mix_name, source, doc_id, epoch, block, draw, n_tokens), a row for
    each use of a document, at most max_repeats of one document in a mix, and all
    uses of an epoch before any of the next; sorted by (block, draw) they are the
    mixture. ``shares``: for each target what it
    reached. Documents of a null source, or of one that a mix doesn't name, take
    no part; a target whose source has no documents reports a share of 0. Null
    shares or repeats count as 0; a source named twice in a mix counts once, by
    its largest share. Repeated doc_ids count as documents of their own.
    """
    t = targets.groupBy("mix_name", "source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    wanted = t.limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    spark = sizes.sparkSession
    named = F.broadcast(t.select("source").distinct())
    docs = materialize(sizes.join(named, "source", "left_semi").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    held = {r["source"]: (r["tokens"], r["docs"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    settings = []
    for mix in sorted({r["mix_name"] for r in wanted if r["mix_name"] is not None}):
        own = {r["source"]: r for r in wanted if r["mix_name"] == mix and r["source"] is not None}
        plan = plan_mix({k: held.get(k, (0, 0))[0] for k in own}, {k: r["target_share"] for k, r in own.items()}, {k: r["max_repeats"] for k, r in own.items()}, (total or {}).get(mix))
        for k, r in sorted(own.items()):
            size, n = held.get(k, (0, 0))
            budget = plan.tokens[k]
            whole = min(int(budget / size + 1e-9), r["max_repeats"]) if size else 0
            rest = max(0.0, budget - whole * size) if whole < r["max_repeats"] else 0.0
            settings.append((mix, k, r["target_share"], r["max_repeats"], plan.exponent, float(budget), whole, float(rest), budget / size if size else 0.0, max(1, math.ceil(n / BUCKET_DOCS))))
    schema = "mix_name string, source string, target_share double, max_repeats int, exponent double, budget double, whole int, rest double, epochs double, buckets int"
    plan_df = spark.createDataFrame(settings, schema)

    def unit(epoch: str) -> Column:
        """Where a document stands in an epoch of a mix, in [0, 1)."""
        return F.shiftrightunsigned(F.xxhash64("doc_id", "mix_name", epoch, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))

    # the part of a last epoch comes behind the whole ones
    placed = docs.join(F.broadcast(plan_df.filter("budget > 0")), "source").withColumn("u", unit("whole"))
    placed = placed.withColumn("bucket", F.floor(F.col("u") * F.col("buckets")).cast("int"))
    # the bucket in which the rest of a source runs out
    sums = placed.filter("rest > 0").groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("c"), F.first("rest").alias("rest"))
    w = W.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    last = sums.withColumn("upto", F.sum("c").over(w)).filter("upto >= rest and upto - c < rest")
    last = last.groupBy("mix_name", "source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("c")).alias("before"))).alias("l"))
    last = materialize(last.select(F.col("mix_name").alias("_m"), F.col("source").alias("_s"), F.col("l.bucket").alias("last_bucket"), F.col("l.before").alias("before")))
    on = (F.col("mix_name") == F.col("_m")) & (F.col("source") == F.col("_s"))
    placed = placed.join(F.broadcast(last), on, "left")
    inner = W.partitionBy("mix_name", "source", "bucket").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    at_edge = placed.filter("rest > 0 and bucket = last_bucket")
    # a document at the edge is used where that brings the sum nearer to the budget
    at_edge = at_edge.withColumn("extra", (F.col("before") + F.sum("n_tokens").over(inner) - F.col("n_tokens") / 2 < F.col("rest")).cast("int"))
    others = placed.filter("not (rest > 0 and last_bucket is not null and bucket = last_bucket)").withColumn("extra", F.when(F.col("rest") > 0, (F.col("bucket") < F.coalesce("last_bucket", F.lit(2**31 - 1))).cast("int")).otherwise(0))
    uses = at_edge.unionByName(others).withColumn("n", F.col("whole") + F.col("extra")).filter("n > 0")
    rows = uses.select("mix_name", "source", "doc_id", "n_tokens", "epochs", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch"))
    position = (F.col("epoch") + unit("epoch")) / F.col("epochs")
    rows = rows.withColumn("block", F.least(F.floor(position * blocks), F.lit(blocks - 1)).cast("int"))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "mix_name", "epoch", "block", F.lit(seed)))
    rows = rows.select("mix_name", "source", "doc_id", "epoch", "block", "draw", "n_tokens")
    reached = uses.groupBy("mix_name", "source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_docs"), F.max("n").alias("most_repeats"))
    report = plan_df.select("mix_name", "source", "target_share", "max_repeats", "exponent", "budget").join(reached, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_docs", "most_repeats"])
    all_ = W.partitionBy("mix_name")
    report = report.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(all_).cast("double")), F.lit(0.0)))
    return Mixture(rows, report)
