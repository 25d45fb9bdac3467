import math
import random

import pytest

from textlode.llm import quantiles as Q


def expected(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v))) - 1]


@pytest.mark.parametrize("ranges", [50_000, 0])
def test_against_sorting(spark, monkeypatch, ranges):
    monkeypatch.setattr(Q, "SMALL_RANGE", 40)  # so that rounds of pivots are needed
    monkeypatch.setattr(Q, "MAX_BROADCAST_RANGES", ranges)  # 0: ranges are joined by salt
    r = random.Random(3)
    rows = []
    for k in range(6000):
        g = r.choice("aaab") if k % 3 else "hot"
        x = r.choice([None, float("nan"), -1.5, 0.0, -0.0, 7.0, r.lognormvariate(5, 2), float(r.randint(0, 5)), r.uniform(1e6, 1e6 + 1)])
        rows.append((g if k % 50 else None, x, k))
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(x.g, x.q): (x.n, x.value) for x in Q.percentiles(df, ["g"], "v", qs).collect()}
    groups = {}
    for g, x, _ in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    assert got == {(g, q): (len(v), expected(v, q)) for g, v in groups.items() for q in qs}


def test_ties_singles_and_nothing(spark):
    df = spark.createDataFrame([("t", 1.0)] * 50 + [("one", 3.0), ("none", None), ("inf", float("inf")), ("inf", 1.0)], "g string, v double")
    got = {(r.g, r.q): r.value for r in Q.percentiles(df, ["g"], "v", [0.5, 1.0]).collect()}
    assert got == {("t", 0.5): 1.0, ("t", 1.0): 1.0, ("one", 0.5): 3.0, ("one", 1.0): 3.0, ("inf", 0.5): 1.0, ("inf", 1.0): float("inf")}
    assert Q.percentiles(df.limit(0), ["g"], "v").count() == 0


def test_weights_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0, 3, "x"), ("a", 2.0, 1, "x"), ("a", 9.0, 0, "x"), ("a", 9.0, None, "x")], "q string, v double, w int, slot string")
    got = {r.q: r.value for r in Q.percentiles(df.withColumnRenamed("q", "grp"), ["grp", "slot"], "v", [0.75, 0.76], "w").collect()}
    assert got == {0.75: 1.0, 0.76: 2.0}


def test_summaries_of_days_within_their_bound(spark):
    r = random.Random(9)
    rows = [(k % 2, k % 7, r.choice([-1, 1, 1, 1]) * r.lognormvariate(3, 3)) for k in range(4000)] + [(0, 1, None), (0, 1, float("nan")), (1, 2, 0.0)] + [(1, 3, float("inf"))] * 30
    df = spark.createDataFrame(rows, "g int, day int, v double")
    merged = Q.merge_summaries(Q.summarize(df, ["g", "day"], "v"), ["g"])
    assert {tuple(x) for x in merged.collect()} == {tuple(x) for x in Q.summarize(df, ["g"], "v").collect()}
    got = {(x.g, x.q): x.value for x in Q.summary_percentiles(merged, ["g"]).collect()}
    exact = {(x.g, x.q): x.value for x in Q.percentiles(df, ["g"], "v").collect()}
    assert got.keys() == exact.keys()
    for k, v in exact.items():
        assert got[k] == v or abs(got[k] - v) <= 0.00501 * abs(v) + 1e-9
