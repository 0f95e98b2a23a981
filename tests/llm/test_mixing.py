"""Mixtures: constraints, water-filling, and the tilt against a plain solver."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing


def test_targets_fill_up_and_overflow_to_the_others():
    sources = [mixing.Source("a", 0.5, 1, 10, 100), mixing.Source("b", 0.5, 9, 10, 900), mixing.Source("c", 0.0, 9, 10, 50), mixing.Source("d", 0.3, 2), mixing.Source("e", 0.2, 0, 5, 70)]
    assert mixing.fill_targets(sources) == pytest.approx(1120)
    assert [s.wanted for s in sources] == pytest.approx([100, 1020, 0, 0, 0])
    short = [mixing.Source("a", 0.5, 1, 1, 10), mixing.Source("b", 0.0, 1, 1, 90)]
    assert mixing.fill_targets(short) == 10
    assert mixing.fill_targets([]) == 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, "big" if i % 2 else rng.choice(["mid", "small", "none", None, "Big"]), rng.choice([0, rng.randint(1, 60), int(rng.paretovariate(1.1) * 30)])) for i in range(4000)]
    rows.append((9999, "mid", 40_000))
    return rows


def test_mixture_meets_every_constraint(spark, corpus):
    tokens = spark.createDataFrame(corpus, "doc_id long, source string, n_tokens long")
    wanted = [("big", 0.3, 1), ("mid", 0.6, 3), ("small", 0.1, 50), ("none", 0.0, 1), ("absent", 0.1, 5), (None, 0.4, 1), ("off", None, None)]
    targets = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int")
    mixture, sources = mixing.mix(tokens, targets)
    rows = mixture.collect()
    by = {s.name: s for s in sources}
    assert {r["source"] for r in rows} <= {"big", "mid", "small", "none"} and len(rows) == sum(s in ("big", "mid", "small", "none") for _, s, _ in corpus)
    assert all(0 <= r["copies"] <= by[r["source"]].repeats for r in rows)
    assert all(r["copies"] == 0 for r in rows if r["n_tokens"] == 0 or r["source"] == "none")
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows if r["source"] != "mid")
    for name in ("big", "mid", "small"):
        used = sum(r["copies"] * r["n_tokens"] for r in rows if r["source"] == name)
        assert used <= by[name].wanted + 1e-6 and used >= 0.998 * by[name].wanted, name
    report = {r["source"]: r for r in mixing.reached_shares(mixture, targets, sources).collect()}
    assert len(report) == 6 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert report["absent"]["tokens_used"] == 0 == report["off"]["tokens_used"]


def test_reach_is_a_running_sum_in_line(spark):
    rng = random.Random(8)
    for room, ties in ((0.0, 1), (700.0, 1), (2_500.0, 3), (1e9, 1)):
        rows = [(i, rng.choice("ab"), rng.choice([0, 3, 40, 900]), rng.randrange(2 << mixing.BITS) >> rng.choice([0, 38]) if ties == 1 else (i // ties) << 20) for i in range(300)]
        line = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, place long")
        sources = [mixing.Source("a", 1.0, 1), mixing.Source("b", 1.0, 1), mixing.Source("it's", 1.0, 1)]
        got = mixing.reach_of(line, {"a": room, "b": room / 2}, sources)
        within = {r["doc_id"] for r in line.where(mixing._within(got, sources, F.col("place"))).collect()}
        want = set()
        for name, free in (("a", room), ("b", room / 2)):
            used = 0
            for doc, _, n, _ in sorted((r for r in rows if r[1] == name), key=lambda r: (r[3], r[0])):
                if used + n > free or free <= 0 and not room:
                    break
                used += n
                want.add(doc)
            assert not room or got[name].tokens == used
        assert within == (want if room else set())


def test_values_by_source_of_any_name_and_size(spark):
    names = ["it's", 'back\\slash "q"', "{x}\nline", "é", "\\'", "%s"]
    values = [1e-07, -5e-324, 1.7e308, 0.1, -3.0, 1e16]
    sources = [mixing.Source(n, v, 2**31 - 1, tokens=-(2**62)) for n, v in zip(names, values, strict=True)]
    df = spark.createDataFrame([(n,) for n in [*names, "other"]], "source string")
    of = lambda f, kind: mixing._by_source(sources, f, kind)
    got = {r[0]: tuple(r)[1:] for r in df.select("source", of(lambda s: s.share, "double"), of(lambda s: s.repeats, "int"), of(lambda s: s.tokens, "bigint"), of(lambda s: s.share > 0, "boolean")).collect()}
    assert got == {n: (v, 2**31 - 1, -(2**62), v > 0) for n, v in zip(names, values, strict=True)} | {"other": (None,) * 4}


def test_tilts_solve_the_dual(spark, corpus):
    lengths = {}
    for _, s, n in corpus:
        if s in ("big", "mid") and n:
            lengths[s, n] = lengths.get((s, n), 0) + 1
    sources = []
    for name, part, repeats in (("big", 0.4, 1), ("mid", 1.7, 3)):
        d = sum(k for (s, _), k in lengths.items() if s == name)
        t = sum(k * n for (s, n), k in lengths.items() if s == name)
        sources.append(mixing.Source(name, 1.0, repeats, d, t, wanted=part * t))
    steps = mixing.balance(spark.createDataFrame([(s, n, k) for (s, n), k in lengths.items()], "source string, n_tokens long, n long"), sources)
    assert steps < mixing.STEPS
    for s in sources:
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            reached = sum(k * n * min(s.repeats, math.exp(min(60, mid * n / s.mean))) for (x, n), k in lengths.items() if x == s.name)
            low, high = (mid, high) if reached < s.wanted else (low, mid)
        assert s.tilt == pytest.approx(low, abs=1e-5)


def test_nothing_to_mix(spark):
    tokens = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixture, sources = mixing.mix(tokens, targets)
    assert mixture.count() == 0 and mixing.reached_shares(mixture, targets, sources).collect()[0]["actual_share"] == 0
    assert mixing.mix(tokens, targets.limit(0))[0].count() == 0
