"""Percentiles of large numeric columns by radix selection.

A double is mapped to an integer that sorts as it does. The integers are histogrammed by their first
digit; for each wanted rank only the digit that contains it is followed, and only rows with that digit are
histogrammed by the next one. Histograms are sums, so those of splits, days or snapshots add up
to that of their union: the finest groups are counted once and every coarser grouping is summed from them.
Everything runs in the engine's own expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, durable

#: Bits of a digit; the first holds sign and exponent with 4 bits of the mantissa.
DIGIT = 16


def _exponent(value: Column) -> Column:
    """The binary exponent of a finite double, possibly off by one; null for 0 and null."""
    return F.least(F.floor(F.log2(F.abs(value))).cast("int"), F.lit(1023))


def _code(value: Column, exponent: Column, power: Column) -> Column:
    """The code from a value, its estimated exponent and two to that exponent."""
    size = F.abs(value)
    less, more = power > size, power * 2.0 <= size
    exact = exponent + F.when(less, -1).when(more, 1).otherwise(0)
    scale = F.when(less, power / 2.0).when(more, power * 2.0).otherwise(power)
    normal = (exact + 1023).cast("bigint") * F.lit(1 << 52) + ((size / scale - 1.0) * F.lit(float(1 << 52))).cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    code = F.when(size == 0, F.lit(0).cast("bigint")).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(value < 0, -code).otherwise(code)


def order_code(value: Column) -> Column:
    """A bigint that sorts as the double does: the bits of its absolute value, signed.

    Exact for every finite double, subnormals included; null for null, NaN and infinities; -0 is 0.
    """
    double = value.cast("double")
    finite = F.when(F.abs(double) < F.lit(float("inf")), double)
    exponent = _exponent(finite)
    return F.when(finite.isNotNull(), _code(finite, exponent, F.pow(F.lit(2.0), exponent)))


def code_value(code: Column) -> Column:
    """The double of an order code."""
    size = F.abs(code)
    exponent = F.shiftright(size, 52).cast("int")
    mantissa = size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (F.lit(1.0) + mantissa / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), exponent - 1023)
    tiny = mantissa * F.lit(2.0**-537) * F.lit(2.0**-537)
    value = F.when(exponent == 0, tiny).otherwise(normal)
    return F.when(code < 0, -value).otherwise(value)


def prefix(code: Column, bits: int) -> Column:
    """The first ``bits`` of a 64-bit code as a number."""
    return F.shiftright(code, 64 - bits)


@dataclass(frozen=True)
class Measure:
    """A column with the values that count."""

    name: str
    low: float
    high: float


def with_codes(df: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """``keys`` and one order code per measure, null for null, NaN and impossible values.

    Logarithm and power are columns of their own, so that each is computed once per value.
    """
    names = [m.name for m in measures]
    values = []
    for m in measures:
        v = F.col(m.name).cast("double")
        values.append(F.when((v >= m.low) & (v <= m.high) & (F.abs(v) < F.lit(float("inf"))), v).alias(m.name))
    rows = df.select(*keys, *values)
    rows = rows.select("*", *[_exponent(F.col(n)).alias(f"_exponent_{n}") for n in names])
    rows = rows.select("*", *[F.pow(F.lit(2.0), F.col(f"_exponent_{n}")).alias(f"_power_{n}") for n in names])
    return rows.select(*keys, *[F.when(F.col(n).isNotNull(), _code(F.col(n), F.col(f"_exponent_{n}"), F.col(f"_power_{n}"))).alias(n) for n in names])


def unpivot(coded: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``keys, measure, code`` of every possible value."""
    cells = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("code")) for m in measures]
    return coded.select(*keys, F.inline(F.array(*cells))).where("code is not null")


def digit_histogram(values: DataFrame, keys: list[str], bits: int = 24) -> DataFrame:
    """``keys, measure, digit, n``: a mergeable summary at a resolution of ``bits`` bits.

    A digit holds values within a factor of 1 + 2**(12 - bits) of each other, which bounds the relative
    error of any percentile read from it. Partial sums are made before the shuffle.
    """
    return values.groupBy(*keys, "measure", prefix(F.col("code"), bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(histograms: list[DataFrame], keys: list[str]) -> DataFrame:
    """The histogram of the union, for any coarser ``keys``: counts of equal digits add up."""
    both = reduce(lambda a, b: a.unionByName(b), histograms)
    return both.groupBy(*keys, "measure", "digit").agg(F.sum("n").alias("n"))


def _rank(p: Column, n: Column) -> Column:
    """Rank from 1 of the smallest value with at least the share ``p`` of all values at or below it.

    ``p`` counts in hundredths of a percent, so that the rank is exact.
    """
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(p * n / F.lit(10_000)).cast("bigint"))


def _targets(histogram: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    whole = histogram.groupBy(*keys, "measure").agg(F.sum("n").alias("n_values"))
    basis = F.array(*[F.lit(round(p * 100)).cast("bigint") for p in percents])
    return whole.select(*keys, "measure", "n_values", F.explode(basis).alias("basis")).withColumn("rank_left", _rank(F.col("basis"), F.col("n_values")))


def _follow(histogram: DataFrame, targets: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The digit that contains each target's rank, with the rank that is left within it.

    The number of digits of a group is bounded by their width, not by its rows.
    """
    window = Window.partitionBy(*keys, *on).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    running = histogram.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))
    match = reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*keys, *on]])
    within = (F.col("t.rank_left") > F.col("h.before")) & (F.col("t.rank_left") <= F.col("h.before") + F.col("h.n"))
    return (
        running.alias("h")
        .join(targets.alias("t"), match & within)
        .select(
            *[F.col(f"t.{c}").alias(c) for c in keys],
            F.col("t.measure").alias("measure"),
            "t.n_values",
            "t.basis",
            (F.col("t.rank_left") - F.col("h.before")).alias("rank_left"),
            F.col("h.digit").alias("digit"),
            *[F.col(f"h.{c}").alias(c) for c in ("low", "high") if c in histogram.columns],
        )
    )


def percentiles_from_histogram(histogram: DataFrame, keys: list[str], percents: list[float], bits: int = 24) -> DataFrame:
    """``keys, measure, percent, n_values, low, high``: bounds of each percentile from a summary.

    The true value lies in [low, high], which differ by a factor of at most 1 + 2**(12 - bits).
    """
    found = _follow(histogram, _targets(histogram, keys, percents), keys, ["measure"])
    low = F.shiftleft(F.col("digit"), 64 - bits)
    return found.select(*keys, "measure", (F.col("basis") / F.lit(100.0)).alias("percent"), "n_values", code_value(low).alias("low"), code_value(low + F.lit((1 << (64 - bits)) - 1)).alias("high"))


def _contains(wanted: Column, digit: Column) -> Column:
    return F.coalesce(F.array_contains(wanted, digit), F.lit(False))


def radix_percentiles(rows: DataFrame, measures: list[str], groupings: dict[str, Column], percents: list[float]) -> DataFrame:
    """Exact percentiles ``grouping, key, measure, percent, n_values, value`` for several groupings at once.

    ``rows`` has one order code per measure (null where there is no possible value) and is read once per
    digit; cut its lineage first. ``groupings`` gives each grouping's key as text. The first pass
    histograms the first digit; each later one only rows whose digits so far are those of a rank still sought,
    and a rank is settled as soon as its digit holds a single value. At most 65,536 digits are summed per
    rank and pass, however many rows a group has. Groups without any possible value give no rows; null
    keys form a group. The digits sought are broadcast only while they are small.
    """
    keys = ["grouping", "key"]
    counted = [F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high")]
    cells = [
        F.struct(F.lit(g).alias("grouping"), key.alias("key"), F.lit(m).alias("measure"), prefix(F.col(m), DIGIT).alias("digit"), F.col(m).alias("code"))
        for g, key in groupings.items()
        for m in measures
    ]
    first = rows.select(F.inline(F.array(*cells))).where("code is not null")
    counts = durable(first.groupBy(*keys, "measure", "digit").agg(*counted))
    found = durable(_follow(counts, _targets(counts, keys, percents), keys, ["measure"]))
    settled = []
    for bits in range(2 * DIGIT, 64 + 2 * DIGIT, DIGIT):
        settled.append(found.where("low = high"))
        open_ones = found.where("low != high")
        if bits > 64 or open_ones.isEmpty():
            break
        followed = []
        sought = durable(open_ones.groupBy(*keys).agg(*[F.collect_set(F.when(F.col("measure") == m, F.col("digit"))).alias(f"want_{m}") for m in measures]))
        for g, key in groupings.items():
            wanted = broadcast_if_small(sought.where(F.col("grouping") == g).drop("grouping").withColumnRenamed("key", "_key"))
            near = [
                F.when(_contains(F.col(f"want_{m}"), prefix(F.col(m), bits - DIGIT)), F.struct(F.lit(m).alias("measure"), F.col(m).alias("code")))
                for m in measures
            ]
            kept = rows.withColumn("key", key).join(wanted, F.col("key").eqNullSafe(F.col("_key")))
            cut = kept.select("key", F.inline(F.filter(F.array(*near), lambda x: x.isNotNull())))
            followed.append(
                cut.groupBy("key", "measure", prefix(F.col("code"), bits - DIGIT).alias("prefix"), prefix(F.col("code"), bits).alias("digit"))
                .agg(*counted)
                .select(F.lit(g).alias("grouping"), "*")
            )
        counts = reduce(lambda a, b: a.unionByName(b), followed)
        found = durable(_follow(counts, open_ones.withColumnRenamed("digit", "prefix"), keys, ["measure", "prefix"]))
    whole = reduce(lambda a, b: a.unionByName(b), settled)
    return whole.select(*keys, "measure", (F.col("basis") / F.lit(100.0)).alias("percent"), "n_values", code_value(F.col("low")).alias("value"))
