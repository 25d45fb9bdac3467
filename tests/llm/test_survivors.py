import itertools
import random

import pytest
from pyspark.sql import functions as F

from textlode.llm import survivors as S

SCHEMA = "extraction_id long, resolve_id long, document_id string, pass int, label string, text string, start_pos int, end_pos int, confidence double, alignment_status string, alignment_score double, raw string, extracted_at timestamp"


def table(spark, rows):
    return spark.createDataFrame([(k, 1, d, p, x, t, a, b, c, s, sc, None, None) for k, d, p, x, t, a, b, c, s, sc in rows], SCHEMA)


def brute(rows):
    rows = list({r[0]: r for r in rows}.values())
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r, s in itertools.combinations(rows, 2):
        if r[1] != s[1] or r[3].strip().lower() != s[3].strip().lower():
            continue
        same = r[5] >= 0 and (r[5], r[6]) == (s[5], s[6]) or min(r[5], s[5]) < 0 and r[4].lower() == s[4].lower()
        if same:
            a, b = sorted((find(r[0]), find(s[0])))
            root[b] = a
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r)
    rank = {"exact": 3, "match_exact": 3, "lesser": 2, "match_greater": 2}
    return {(min(x[0] for x in g), min(g, key=lambda x: (-rank.get(x[8], 1), -(x[9] or 0), -(x[7] or 0), x[2], x[0]))[0]) for g in groups.values() if len(g) > 1}


def test_against_brute_force(spark):
    r = random.Random(11)
    rows = []
    for k in range(1, 260):
        off = r.random() < 0.3
        a = r.randint(0, 6)
        rows.append((k, "hot" if r.random() < 0.4 else r.choice("ab"), r.randint(0, 2), r.choice(["person", " Person ", "place"]), r.choice(["Bob", "BOB", "Al", "Cy", "Straße"]), -1 if off else a, -1 if off else a + 3, r.choice([None, 0.5, 0.9]), r.choice(["exact", "match_greater", "fuzzy", None, "odd"]), r.choice([None, 0.0, 1.0])))
    rows += rows[:20]
    got = {tuple(x) for x in S.best_records(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_chains_of_spans_and_texts(spark):
    # spans of several texts join unaligned records of different texts
    rows = [(1, "d", 0, "p", "t0", -1, -1, None, None, None)]
    for k in range(40):
        rows += [(10 * k + 10, "d", 0, "p", f"t{k}", k, k + 1, None, "exact", 1.0), (10 * k + 11, "d", 0, "p", f"t{k + 1}", k, k + 1, None, "exact", 1.0), (10 * k + 12, "d", 0, "p", f"t{k + 1}", -1, -1, None, None, None)]
    assert [tuple(x) for x in S.best_records(table(spark, rows)).collect()] == [(1, 10)]


def test_odd_rows(spark):
    rows = [(1, None, 0, "p", "x", 0, 1, None, None, None), (2, "d", 0, None, "x", 0, 1, None, None, None), (3, "d", 0, "p", None, -1, -1, None, None, None), (4, "d", 0, "p", None, -1, -1, None, None, None), (5, "d", None, "p", "y", None, None, float("nan"), None, None), (6, "d", 0, "p", "y", 3, 4, None, None, None)]
    assert [tuple(x) for x in S.best_records(table(spark, rows)).collect()] == [(5, 6)]
    assert S.best_records(table(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 540)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {(x.v, x.root) for x in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, find(k)) for k in linked}


def test_components_of_a_hub(spark):
    """A node with 100 000 links is spread over tasks, and no task gets the most of them."""
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = S.components(edges)
    assert got.count() == 100_001 and got.filter("root <> 0").isEmpty()
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).repartition(8)
    parts = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(S.SALTS))).groupBy("s").count()
    assert parts.count() == S.SALTS and parts.agg(F.max("count")).first()[0] < 2 * 100_000 / S.SALTS
    least = S._with_least(links.union(links.select("v", "u")))
    assert least.count() == 200_000 and {r.m for r in least.filter("u = 0").select("m").distinct().collect()} == {1}


def test_components_that_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        S.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))


def test_levels_of_trust(spark):
    """Levels are compared one after the other, whatever their sizes; a group keeps its aggregates."""
    df = spark.createDataFrame([(1, "a", 1.0, 500.0), (1, "b", 2.0, None), (1, "c", 2.0, -3.0), (None, "d", 9.0, 9.0)], "g int, x string, hi double, lo double")
    out = S.assemble(df, "g", [S.Bundle("all", ("x",), ("hi", "lo"))], keep=[F.count("*").alias("n")]).collect()
    assert [(r.g, r.x, r.trust.l0, r.trust.l1, r.n) for r in out] == [(1, "b", 2.0, 0.0, 3)]
    with pytest.raises(ValueError):
        S.assemble(df, "g", [S.Bundle("one", ("x",), ("hi", "lo")), S.Bundle("two", ("lo",), "lo")])


def slow_assemble(records):
    best = None
    for m, b, o in itertools.product(records, records, records):
        if not any(r[:2] == m[:2] and r[3] == o[3] for r in records):
            continue  # the place isn't attested with that origin
        key = (-round(m[4] + (b[2] or 0) + o[5], 9),)
        if best is None or key < best[0]:
            best = (key, m, b, o)
    return -best[0][0]


def test_bundles_against_brute_force(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(30):
        records = []
        for _ in range(r.randint(1, 7)):
            a = r.randint(0, 3)
            records.append((a, a + 1, r.choice([None, 0.1, 0.8]), r.randint(0, 3), round(r.random(), 2), round(r.random(), 2)))
        want[g] = slow_assemble(records)
        rows += [(g, *x) for x in records]
    df = spark.createDataFrame(rows, "g int, st int, en int, conf double, src int, t1 double, t2 double")
    bundles = [S.Bundle("place", ("st", "en"), "t1"), S.Bundle("belief", ("conf",), "conf"), S.Bundle("origin", ("src",), "t2")]
    out = S.assemble(df, "g", bundles, [S.Dependency("place", ("st", "en"), "origin", ("src",))]).collect()
    assert {x.g: round(x.trust, 6) for x in out} == {k: round(v, 6) for k, v in want.items()}
    pairs = {(x[0], x[1], x[2], x[4]) for x in rows}
    assert all((x.g, x.st, x.en, x.src) in pairs for x in out)


def test_merged_records(spark):
    rows = [(1, "d", 0, "p", "Bob", 0, 3, 0.2, "exact", 1.0), (2, "d", 1, "p", "Bob", 0, 3, 0.9, "fuzzy", 0.8), (3, "d", 0, "q", "x", 5, 6, None, None, None)]
    out = {x.root: x for x in S.merged_records(table(spark, rows)).collect()}
    assert len(out) == 2 and (out[1].alignment_status, out[1].confidence, out[1]["pass"], out[1].n_records) == ("exact", 0.9, 0, 2)
    assert S.group_of_records(table(spark, rows)).filter(F.col("root").isNull()).count() == 0
