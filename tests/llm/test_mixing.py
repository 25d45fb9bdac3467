import pytest
from pyspark.sql import functions as F

from textlode.llm import mixing as X
from textlode.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_temperature_and_entropy():
    sizes = {"a": 900.0, "b": 90.0, "c": 10.0, "none": 0.0}
    assert X.temperature_shares(sizes, 1)["a"] == pytest.approx(0.9)
    assert X.temperature_shares(sizes, 0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "none": 0})
    for wanted in (0.6, 0.9, 1.05):
        assert X.entropy(X.temperature_shares(sizes, X.exponent_for_entropy(sizes, wanted))) == pytest.approx(wanted, abs=1e-6)


def test_plans():
    sizes, targets, repeats = {"a": 100, "b": 10}, {"a": 0.5, "b": 0.5, "gone": 0.5}, {"a": 1, "b": 4, "gone": 9}
    p = X.plan_mix(sizes, targets, repeats)
    assert p.exponent == 1 and p.tokens == pytest.approx({"a": 40, "b": 40, "gone": 0})
    wide = X.plan_mix(sizes, targets, repeats, total=100)
    assert 0 < wide.exponent < 1 and wide.tokens["b"] == pytest.approx(40) and sum(wide.tokens.values()) == pytest.approx(100)
    most = X.plan_mix(sizes, targets, repeats, total=10_000)
    assert most.tokens["a"] <= 100 and most.tokens["b"] <= 40
    assert X.plan_mix({}, {"x": 1.0}, {"x": 1}).total == 0


def mixture(spark, docs, targets, **k):
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, epoch int") if docs else spark.createDataFrame([], "doc_id long, source string, n_tokens long, epoch int")
    return X.mix_sources(sizes, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int"), **k)


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_DOCS", 50)  # so that several buckets are needed
    docs = [(k, "hot", 10 + k % 7, 0) for k in range(2000)] + [(5000 + k, "small", 5 + k % 3, 0) for k in range(120)] + [(7000 + k, None, 5, 0) for k in range(5)] + [(8000, "other", 9, 0)]
    targets = [("m", "hot", 0.5, 1), ("m", "small", 0.3, 3), ("m", "missing", 0.2, 5), ("n", "small", 1.0, 2), ("n", "small", 0.4, 1)]
    m = mixture(spark, docs, targets)
    rows = m.rows.collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.mix_name, r.source, r.doc_id), []).append(r.epoch)
        assert 0 <= r.block < 64
    assert all(sorted(e) == list(range(len(e))) for e in uses.values())
    assert {k[1] for k in uses} == {"hot", "small"}
    assert max(len(e) for (mix, s, _), e in uses.items() if (mix, s) == ("m", "hot")) == 1
    assert {len(e) for (mix, s, _), e in uses.items() if (mix, s) == ("m", "small")} == {3}
    assert {len(e) for (mix, _, _), e in uses.items() if mix == "n"} == {2}
    shares = {(r.mix_name, r.source): r for r in m.shares.collect()}
    assert shares["m", "missing"].reached_share == 0 and shares["m", "small"].tokens == sum(r.n_tokens for r in rows if (r.mix_name, r.source) == ("m", "small"))
    assert shares["m", "hot"].reached_share == pytest.approx(0.625, abs=0.005)
    again = mixture(spark, docs, targets).rows
    assert again.exceptAll(m.rows).count() == 0


def test_every_epoch_has_an_order_of_its_own(spark):
    docs = [(k, "a", 5, 0) for k in range(400)] + [(1000 + k, "b", 20, 0) for k in range(400)]
    rows = mixture(spark, docs, [("m", "a", 0.5, 4), ("m", "b", 0.5, 1)], blocks=40).rows.collect()
    first, second = ({r.doc_id: r.block % 10 for r in rows if r.source == "a" and r.epoch == e} for e in (0, 1))
    same = sum(first[k] == second[k] for k in first)
    assert len(first) == len(second) == 400 and same < 100  # about a tenth by chance
    for block in range(40):  # every block holds both sources in their weight, mixed
        inside = sorted((r.draw, r.source, r.n_tokens) for r in rows if r.block == block)
        tokens = {x: sum(n for _, y, n in inside if y == x) for x in "ab"}
        assert 0.15 < tokens["a"] / sum(tokens.values()) < 0.85
        assert sum(x[1] != y[1] for x, y in zip(inside, inside[1:], strict=False)) > 4


def test_a_sized_mix_reports_the_exponent_of_its_shares(spark):
    docs = [(k, "a", 10, 0) for k in range(900)] + [(1000 + k, "b", 10, 0) for k in range(100)]
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.5, 3)]
    shares = {r.source: r for r in mixture(spark, docs, targets, total={"m": 10_000.0}).shares.collect()}
    a = shares["a"].exponent
    assert 0 < a < 1
    weight = {"a": 0.9 ** (1 - a) * 0.5**a, "b": 0.1 ** (1 - a) * 0.5**a}
    for k, r in shares.items():
        assert r.reached_share == pytest.approx(weight[k] / sum(weight.values()), abs=0.01)


def test_uneven_last_epoch(spark):
    docs = [(k, "a", 7, 0) for k in range(40)] + [(100 + k, "b", 11, 0) for k in range(50)]
    m = mixture(spark, docs, [("m", "a", 0.5, 9), ("m", "b", 0.5, 1)])
    t = {r.source: r.t for r in m.rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert t["b"] == 550 and abs(t["a"] - 550) <= 7


def test_odd_tables(spark):
    assert mixture(spark, [], [("m", "a", 1.0, 1)]).rows.count() == 0
    assert mixture(spark, [(1, "a", None, 0)], [("m", "a", None, None), (None, "a", 1.0, 1)]).shares.count() == 1
    assert mixture(spark, [(1, "a", 5, 0)], []).rows.count() == 0


def test_the_bisection_decides_in_mixes_of_a_given_size(spark):
    plain = {(r.mix_name, r.source): r for r in QUERIES["p8_shares"](spark, SMALL).collect()}
    sized = {(r.mix_name, r.source): r for r in QUERIES["p8_sized_shares"](spark, SMALL).collect()}
    assert plain.keys() == sized.keys() and {r.exponent for r in plain.values()} == {1.0}
    assert any(0 < r.exponent < 1 for r in sized.values())
    for mix in {m for m, _ in sized}:
        own = [r for (m, _), r in sized.items() if m == mix]
        assert sum(r.budget for r in own) >= sum(r.budget for (m, _), r in plain.items() if m == mix) * (1 - 1e-9) or own[0].exponent == 1
        assert all((r.most_repeats or 0) <= r.max_repeats for r in own)
