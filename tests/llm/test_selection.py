"""Percentiles and top N against brute force, with hot groups, nulls, ties and odd values."""

import math
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import percentiles as P
from plumbline.llm.topn import top_n_per_group


def test_order_codes_sort_and_come_back(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 8.0, math.nextafter(8, 0)]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if math.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("c", P.order_code(F.col("v"))).withColumn("back", P.code_value(F.col("c")))
    got = {r["v"]: (r["c"], r["back"]) for r in df.collect()}
    assert all(b == v for v, (_, b) in got.items())
    order = sorted(got)
    assert [got[v][0] for v in order] == sorted(got[v][0] for v in order)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert odd.where(P.order_code(F.col("v")).isNotNull()).count() == 0


def expected(values, percent):
    values = sorted(values)
    return values[max(1, -(-round(percent * 100) * len(values) // 10_000)) - 1]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 else rng.choice(["a", "b", None])
        x = rng.choice([rng.gauss(0, 1e6), rng.choice([1.5, 1.5, -0.0]), rng.uniform(1, 1 + 1e-9), float("nan"), None])
        rows.append((g, f"d{i % 4}", x, rng.choice([None, -1, 3, 2**31 - 1])))
    return rows


def test_radix_percentiles_equal_sorting(spark, mixed):
    df = spark.createDataFrame(mixed, "g string, day string, x double, y int")
    measures = [P.Measure("x", -1e300, 1e300), P.Measure("y", 0, 1e6)]
    percents = [0.0, 1.0, 33.33, 50.0, 99.0, 100.0]
    got = P.radix_percentiles(P.with_codes(df, ["g", "day"], measures), ["x", "y"], {"g": F.col("g"), "day": F.col("day")}, percents)
    want = defaultdict(list)
    for g, d, x, y in mixed:
        for key in (("g", g), ("day", d)):
            if x is not None and not math.isnan(x):
                want[(*key, "x")].append(x)
            if y is not None and 0 <= y <= 1e6:
                want[(*key, "y")].append(float(y))
    assert {(r["grouping"], r["key"], r["measure"], r["percent"]): (r["n_values"], r["value"]) for r in got.collect()} == {(*k, p): (len(v), expected(v, p)) for k, v in want.items() for p in percents}


def test_merged_histograms_bound_the_exact_value(spark, mixed):
    df = spark.createDataFrame(mixed, "g string, day string, x double, y int")
    coded = P.with_codes(df, ["g", "day"], [P.Measure("x", -1e300, 1e300)])
    days = [P.digit_histogram(P.unpivot(coded.where(F.col("day") == f"d{k}"), ["g"], ["x"]), ["g"]) for k in range(4)]
    merged = P.percentiles_from_histogram(P.merge_histograms(days, ["g"]), ["g"], [10.0, 50.0, 90.0])
    values = defaultdict(list)
    for g, _, x, _ in mixed:
        if x is not None and not math.isnan(x):
            values[g].append(x)
    rows = merged.collect()
    assert len(rows) == 3 * len(values)
    for r in rows:
        exact = expected(values[r["g"]], r["percent"])
        assert min(r["low"], r["high"]) <= exact <= max(r["low"], r["high"])
        assert abs(r["high"] - r["low"]) <= abs(exact) * 2.0**-12 * 1.01 + 1e-300


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    coded = P.with_codes(df, ["g"], [P.Measure("x", 0, 1)])
    assert P.radix_percentiles(coded, ["x"], {"g": F.col("g")}, [50.0]).count() == 0
    assert P.radix_percentiles(coded.limit(0), ["x"], {"g": F.col("g")}, [50.0]).count() == 0


def test_top_n_with_ties_repeats_nulls_and_a_hot_group(spark):
    rng = random.Random(5)
    rows = []
    for i in range(9000):
        g = "hot" if i % 2 else rng.choice(["a", "B", "b", "", None, *map(str, range(60))])
        rows.append((g, rng.randrange(4000), rng.randrange(6), rng.choice(["x", "y", "é", "Z", "", None]), "clash"))
    rows += rows[:2000]
    df = spark.createDataFrame(rows, "project string, id long, score int, name string, item string").repartition(9)
    got = defaultdict(list)
    for r in top_n_per_group(df, "project", "id", [-F.col("score"), F.col("name")], 5, ["int", "string"]).collect():
        got[r["project"]].append((r["rank_no"], r["id"]))
    want = {}
    for g in {r[0] for r in rows} - {None}:
        best = sorted({(-s, (0, b"") if n is None else (1, n.encode()), i) for p, i, s, n, _ in rows if p == g})
        ids = list(dict.fromkeys(i for _, _, i in best))[:5]
        want[g] = [(k + 1, i) for k, i in enumerate(ids)]
    assert {g: sorted(x) for g, x in got.items()} == want
    assert top_n_per_group(df.limit(0), "project", "id", [F.col("score")], 5, ["int"]).count() == 0
