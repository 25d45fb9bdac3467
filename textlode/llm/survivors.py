"""One surviving record for each group of records that tell of the same mention.

Grouping: records share a mention by span, or by text where one of them is
unaligned, closed transitively. Spans and unaligned texts are the nodes of a
graph that is aggregated before it is built, so only nodes, never records, are
linked; components are found by contraction in O(log n) rounds.

Choice: dependent fields form bundles, which are taken whole. Branch and bound
over the bundles maximises the summed trust under functional dependencies
between them: the best whole record of a group is the incumbent, the best
values of the bundles still open bound a branch from above, and branches below
the incumbent are cut. Branches follow the pairs of values that records attest,
never the product of a group with itself. Trust has levels that are compared one
after the other; sums and bounds are taken level by level, which keeps the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlode.core.jstext import js_trim
from textlode.core.session import discard, materialize

#: Rounds of contraction at most. The number of rounds grows with the logarithm of the longest chain, so that more than this is a fault.
MAX_ROUNDS = 200
#: Parts that the links of one node are spread over.
SALTS = 64


def status_rank(status: Column | str) -> Column:
    """3 for exact, 2 for lesser, 1 for fuzzy; core names as their kin, unknown names and null as fuzzy."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isin("exact", "match_exact"), 3).when(s.isin("lesser", "match_lesser", "match_greater"), 2).otherwise(1)


def _with_least(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the least v of each u.

    The links of a node lie in up to SALTS parts, by v; each part is aggregated
    by itself, and the least of a node is handed out to the parts that it has,
    so that a node with very many links is never in one task.
    """
    salted = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return salted.join(least.select("u", "m", F.explode("s").alias("s")), ["u", "s"]).drop("s")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each node of ``edges`` (a, b): the smallest node of its component.

    Alternates large-star and small-star contraction until every node hangs on a
    root alone. Each round is written to the shared folder, the one before is
    removed.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        around = _with_least(links.union(links.select("v", "u")))
        m = F.least("m", "u")
        large = around.select(F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("u"), m.alias("v")).filter("u <> v").distinct()
        down = _with_least(large)
        new = materialize(down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(links)
        links = new
        # stable once no root hangs on anything, and no node on two
        roots = links.select(F.col("v").alias("u")).distinct()
        if links.join(roots, "u", "left_semi").isEmpty() and links.groupBy("u").count().filter("count > 1").isEmpty():
            return links.select(F.col("u").alias("v"), F.col("v").alias("root")).union(links.select("v", F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def mention_groups(df: DataFrame, keep: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): the nodes of the mention graph, each with its ``root``.

    spans: doc, lab, st, en of aligned records; texts: doc, lab, lt of unaligned
    ones. Both carry first and last extraction_id and ``pref``, the preferred
    record as a struct that compares by preference. Records without document,
    label or extraction_id tell of no mention; an unaligned one without text
    neither. Repeated rows count once.
    """
    none = F.lit(0.0)
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), none), none)
    pref = F.struct(
        status_rank("alignment_status").alias("status"),
        number("alignment_score").alias("score"),
        number("confidence").alias("confidence"),
        (-F.coalesce(F.col("pass"), F.lit(2**31 - 1)).cast("bigint")).alias("early"),
        (-F.col("extraction_id")).alias("neg_id"),
    )
    r = df.select(
        F.col("document_id").alias("doc"), F.lower(js_trim("label")).alias("lab"), F.col("start_pos").alias("st"), F.col("end_pos").alias("en"),
        F.lower(F.upper("text")).alias("lt"), F.col("extraction_id").alias("id"), pref.alias("pref"),
    ).filter("doc is not null and lab is not null and id is not null")
    stats = (F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("pref").alias("pref"))
    aligned = F.coalesce((F.col("st") >= 0) & F.col("en").isNotNull(), F.lit(False))
    at = r.filter(aligned).groupBy("doc", "lab", "st", "en", "lt").agg(*stats)
    off = materialize(r.filter(~aligned & F.col("lt").isNotNull()).groupBy("doc", "lab", "lt").agg(*stats))
    at = at.join(off.select("doc", "lab", "lt", F.col("first_id").alias("tn")), ["doc", "lab", "lt"], "left")
    w = W.partitionBy("doc", "lab", "st", "en")
    spans = materialize(at.withColumn("least_tn", F.min("tn").over(w)))
    # texts that one span links; nearly always none, as a span has one text
    links = spans.filter("tn is not null and tn <> least_tn").select(F.col("tn").alias("a"), F.col("least_tn").alias("b")).distinct()
    node = F.coalesce("least_tn", F.min("first_id").over(w))
    if links.isEmpty():
        return spans.withColumn("root", node).drop("tn", "least_tn"), off.withColumn("root", F.col("first_id"))
    roots = materialize(components(links).select(F.col("v").alias("_v"), F.col("root").alias("_root")))
    spans = spans.withColumn("_node", node).join(roots, F.col("_node") == F.col("_v"), "left").withColumn("root", F.coalesce("_root", "_node"))
    texts = off.join(roots, F.col("first_id") == F.col("_v"), "left").withColumn("root", F.coalesce("_root", "first_id"))
    return spans.drop("tn", "least_tn", "_node", "_v", "_root"), texts.drop("_v", "_root")


def best_records(df: DataFrame) -> DataFrame:
    """(first_id, survivor_id) of each group of two or more records of one mention.

    The record is one bundle here, whose trust has the levels of the preference;
    a node of the graph stands for its records by the preferred one.
    """
    spans, texts = mention_groups(df)
    columns = ("root", "first_id", "last_id", "pref")
    nodes = spans.select(*columns).unionByName(texts.select(*columns)).select("root", "first_id", "last_id", "pref.*", (-F.col("pref.neg_id")).alias("survivor_id"))
    best = assemble(nodes, "root", [RECORD], keep=(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")))
    return best.filter("first_id < last_id").select("first_id", "survivor_id")


def group_of_records(df: DataFrame) -> DataFrame:
    """Each distinct record of ``df`` with the ``root`` of its group (null where it tells of no mention).

    Roots are looked up with what names a mention alone; whole records are
    shuffled once, by their id.
    """
    spans, texts = mention_groups(df)
    r = df.select("extraction_id", F.col("document_id").alias("_doc"), F.lower(js_trim("label")).alias("_lab"), F.lower(F.upper("text")).alias("_lt"), "start_pos", "end_pos").dropDuplicates(["extraction_id"])
    s = spans.select(F.col("doc").alias("_d"), F.col("lab").alias("_l"), F.col("st").alias("_s"), F.col("en").alias("_e"), F.col("root").alias("_r1")).distinct()
    t = texts.select(F.col("doc").alias("_d2"), F.col("lab").alias("_l2"), F.col("lt").alias("_t2"), F.col("root").alias("_r2"))
    r = r.join(s, (F.col("_doc") == F.col("_d")) & (F.col("_lab") == F.col("_l")) & (F.col("start_pos") == F.col("_s")) & (F.col("end_pos") == F.col("_e")), "left")
    aligned = F.coalesce(F.col("start_pos") >= 0, F.lit(False))
    r = r.join(t, (F.col("_doc") == F.col("_d2")) & (F.col("_lab") == F.col("_l2")) & (F.col("_lt") == F.col("_t2")) & ~aligned, "left")
    roots = r.select(F.col("extraction_id").alias("_id"), F.coalesce("_r1", "_r2").alias("root"))
    whole = df.dropDuplicates(["extraction_id"])
    return whole.join(roots, F.col("extraction_id").eqNullSafe(F.col("_id"))).select("root", *df.columns)


@dataclass(frozen=True)
class Bundle:
    """Fields that are taken together, with their trust: a number (null counts as 0) for each level, as SQL expressions over the record."""

    name: str
    fields: tuple[str, ...]
    trust: str | tuple[str, ...]

    @property
    def levels(self) -> tuple[str, ...]:
        return (self.trust,) if isinstance(self.trust, str) else self.trust


@dataclass(frozen=True)
class Dependency:
    """Chosen values of ``left`` (a bundle's fields) must stand with those of ``right`` (a later bundle's) in some record."""

    left: str
    left_fields: tuple[str, ...]
    right: str
    right_fields: tuple[str, ...]


def _level_sum(parts: Sequence[str], levels: int, signs: Sequence[int] | None = None) -> Column:
    """The sum of trusts, level by level, rounded to nine digits so that order doesn't matter. Structs compare level by level."""
    signs = signs or [1] * len(parts)
    each = (reduce(lambda a, b: a + b, (F.col(p)[f"l{k}"] * F.lit(float(s)) for p, s in zip(parts, signs, strict=True)), F.lit(0.0)) for k in range(levels))
    return F.struct(*(F.round(x, 9).alias(f"l{k}") for k, x in enumerate(each)))


def assemble(records: DataFrame, group: str, bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = (), keep: Sequence[Column] = ()) -> DataFrame:
    """(group, fields of all bundles, trust, keep...): the most trusted consistent combination of bundles for each group.

    Ties go to the smallest values, field by field. Rows of a null group are
    left out. Every group keeps a result: its best whole record is consistent.
    ``trust`` is a number, or a struct where bundles have several levels;
    ``keep`` are aggregates over all rows of the group.
    """
    n = len(bundles[0].levels)
    if any(len(b.levels) != n for b in bundles):
        raise ValueError("bundles differ in their levels of trust")
    trusts = {f"_t_{b.name}": F.struct(*(F.coalesce(F.expr(x).cast("double"), F.lit(0.0)).alias(f"l{k}") for k, x in enumerate(b.levels))) for b in bundles}
    r = records.filter(F.col(group).isNotNull()).withColumns(trusts)

    def signature(b: Bundle) -> list[str]:
        return sorted({f for d in dependencies for name, fields in ((d.left, d.left_fields), (d.right, d.right_fields)) if name == b.name for f in fields})

    def order(b: Bundle) -> Column:
        return F.struct(_level_sum([f"_t_{b.name}"], n, [-1]).alias("o"), F.struct(*b.fields).alias("v"))

    total = _level_sum(list(trusts), n)
    # bundles that no dependency touches are decided along with the bounds: their best value is best for all branches
    free = [b for b in bundles if not signature(b)]
    stats = [total_max for b in bundles for total_max in [F.max(f"_t_{b.name}").alias(f"_max_{b.name}")]]
    stats += [F.min(order(b)).alias(f"_best_{b.name}") for b in free] + [F.max(total).alias("_incumbent")]
    tied = [b for b in bundles if signature(b)]
    if tied:
        r = materialize(r)
        # a group of one record has one branch; it's done with its bounds
        stats += [F.count("*").alias("_best_rows"), F.any_value(F.struct(*dict.fromkeys(f for b in bundles for f in b.fields))).alias("_best_only")]
    bounds = r.groupBy(group).agg(*stats, *keep)
    kept_names = [c for c in bounds.columns if c not in (group, "_incumbent") and not c.startswith(("_max_", "_best_"))]
    branch = bounds
    if tied:
        all_bounds = materialize(bounds)
        single, bounds = all_bounds.filter("_best_rows = 1"), all_bounds.filter("_best_rows > 1")
        limits = bounds.select(F.col(group).alias("_g"), "_incumbent", *(f"_max_{b.name}" for b in bundles))
        alive = r = materialize(r.join(limits, F.col(group) == F.col("_g")).drop("_g"))
        # a value that can't reach the incumbent even beside the best of all other bundles is cut;
        # of values that no dependency tells apart only the most trusted stays
        kept: dict[str, DataFrame] = {}
        for b in tied:
            reach = _level_sum([f"_t_{b.name}", *(f"_max_{o.name}" for o in bundles if o is not b)], n)
            best = alive.filter(reach >= F.col("_incumbent")).groupBy(group, *(F.col(f).alias(f"_k_{b.name}_{f}") for f in signature(b))).agg(F.min(order(b)).alias("o"))
            kept[b.name] = best.select(group, *(c for c in best.columns if c.startswith("_k_")), F.col("o.v").alias(f"_v_{b.name}"), _level_sum(["o.o"], n, [-1]).alias(f"_t_{b.name}"))
        branch = bounds.join(kept[tied[0].name], group)
        for at, b in enumerate(tied[1:], 1):
            to = [d for d in dependencies if d.right == b.name]
            on = branch
            for k, d in enumerate(to):
                attested = r.select(group, *(F.col(f).alias(f"_k_{d.left}_{f}") for f in d.left_fields), *(F.col(f).alias(f"_k_{d.right}_{f}") for f in d.right_fields)).distinct()
                keys = [group, *(f"_k_{d.left}_{f}" for f in d.left_fields)]
                on = _join_null_safe(on, attested, keys if k == 0 else keys + [f"_k_{d.right}_{f}" for f in d.right_fields])
                if k == 0:
                    on = _join_null_safe(on, kept[b.name], [group, *(f"_k_{d.right}_{f}" for f in d.right_fields)])
            if not to:
                on = on.join(kept[b.name], group)
            done = [f"_t_{o.name}" for o in tied[: at + 1]] + [f"_max_{o.name}" for o in [*tied[at + 1 :], *free]]
            branch = on.filter(_level_sum(done, n) >= F.col("_incumbent"))
    values = {b.name: F.col(f"_v_{b.name}") if b in tied else F.col(f"_best_{b.name}.v") for b in bundles}
    reached = _level_sum([f"_t_{b.name}" if b in tied else f"_max_{b.name}" for b in bundles], n)
    out = branch.withColumn("trust", reached).withColumns({f"_v_{k}": v for k, v in values.items()})
    if tied:
        first = F.struct(_level_sum(["trust"], n, [-1]).alias("o"), *(F.col(f"_v_{b.name}") for b in bundles))
        columns = ["trust", *(f"_v_{b.name}" for b in bundles), *kept_names]
        out = out.groupBy(group).agg(F.min_by(F.struct(*columns), first).alias("o")).select(group, "o.*")
    trust = (F.col("trust.l0") if n == 1 else F.col("trust")).alias("trust")
    out = out.select(group, *(F.col(f"_v_{b.name}")[f].alias(f) for b in bundles for f in b.fields), trust, *kept_names)
    if tied:
        own = single.withColumn("trust", F.col("_incumbent"))
        out = out.unionByName(own.select(group, *(F.col("_best_only")[f].alias(f) for b in bundles for f in b.fields), trust, *kept_names))
    return out


def _join_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    c = b.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(c[f"_r{k}"]) for k in keys))
    return a.join(c, on).drop(*(f"_r{k}" for k in keys))


# The bundles of an extraction. Trust has the levels of the preference: status, alignment score, confidence, earlier pass.
_STATUS = "CASE WHEN alignment_status IN ('exact', 'match_exact') THEN 3 WHEN alignment_status IN ('lesser', 'match_lesser', 'match_greater') THEN 2 ELSE 1 END"
MENTION = Bundle("mention", ("text", "start_pos", "end_pos", "alignment_status", "alignment_score"), (_STATUS, "nanvl(alignment_score, 0)", "0", "0"))
BELIEF = Bundle("belief", ("confidence",), ("0", "0", "nanvl(confidence, 0)", "0"))
ORIGIN = Bundle("origin", ("resolve_id", "pass", "raw", "extracted_at"), ("0", "0", "0", "-coalesce(pass, 2147483647)"))
#: A record as a whole, by the fields of ``pref`` in mention_groups.
RECORD = Bundle("record", ("survivor_id",), ("status", "score", "confidence", "early"))
#: The chunk that a record comes from decides where its mention stands.
WHERE = Dependency("mention", ("start_pos", "end_pos"), "origin", ("resolve_id",))


def merged_records(df: DataFrame) -> DataFrame:
    """One record built for each group of mentions, single ones included: (root, document_id, label and the bundles' fields)."""
    fields = dict.fromkeys(f for b in (MENTION, BELIEF, ORIGIN) for f in b.fields)
    grouped = group_of_records(df).filter("root is not null").select("root", "document_id", F.lower(js_trim("label")).alias("label"), *fields)
    keep = (F.any_value("document_id").alias("document_id"), F.any_value("label").alias("label"), F.count("*").alias("n_records"))
    return assemble(grouped, "root", [MENTION, BELIEF, ORIGIN], [WHERE], keep).select("root", "document_id", "label", "n_records", *fields, "trust")
