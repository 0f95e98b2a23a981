"""Mixing sources to target shares of all tokens, by entropy balancing.

Each document starts with rate 1. Among all rates that give a source its tokens, those nearest to 1 in
relative entropy are exponential in the document's tokens; the one number per source that tilts them is
the dual variable of its token constraint. It is found by Newton steps on the convex dual, each a
distributed sum over the counts of document lengths, with the cap on repeats as an upper bound of the
rates. Rates are then rounded into copies so that each source keeps its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, durable

#: Newton steps at most, and the relative error of a source's tokens at which they stop.
STEPS, PRECISION = 60, 1e-7
#: Slots by which documents are summed before any single one is looked at, and the bits of a document's place in line.
SLOTS, BITS = 4_096, 40
#: Share of a source's tokens that rounding may leave, and the passes that it takes at most to get there.
SHORT, PASSES = 2e-4, 24
_HIGHEST = 60.0


@dataclass
class Source:
    """What is known of one source; the numbers of all sources fit on the driver."""

    name: str
    share: float
    repeats: int
    documents: int = 0
    tokens: int = 0
    wanted: float = 0.0
    tilt: float = 0.0

    @property
    def most(self) -> int:
        return self.tokens * self.repeats

    @property
    def mean(self) -> float:
        return self.tokens / self.documents if self.documents else 1.0


def fill_targets(sources: list[Source]) -> float:
    """Set the tokens wanted of each source; gives the total that is reached.

    The total is that of all sources' documents. A source that cannot reach its share even with all
    repeats gives all it has, and the others make up for it in proportion to their shares, as far as
    they can. Sources without share, repeats or text give nothing.
    """
    whole = sum(s.tokens for s in sources)
    open_ones = [s for s in sources if s.share > 0 and s.most > 0]
    for s in sources:
        s.wanted = 0.0
    left = float(whole)
    while open_ones:
        scale = left / sum(s.share for s in open_ones)
        full = [s for s in open_ones if s.share * scale >= s.most]
        if not full:
            for s in open_ones:
                s.wanted = s.share * scale
            break
        for s in full:
            s.wanted = float(s.most)
            left -= s.wanted
        open_ones = [s for s in open_ones if s not in full]
    return sum(s.wanted for s in sources)


def read_targets(targets: DataFrame) -> list[Source]:
    """One entry per named source of the small table of targets.

    Null or negative shares and repeats read as 0; of a repeated source the first by share and repeats counts.
    """
    rows = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.min(F.struct(F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("repeats"))).alias("t"))
        .orderBy("source")
        .collect()
    )
    return [Source(r["source"], r["t"]["share"], r["t"]["repeats"]) for r in rows]


def _by_source(sources: list[Source], value: Callable[[Source], float | int], kind: str) -> Column:
    """The value of a row's source: one map literal, parsed in one call, as each call to the engine takes its time."""
    suffix = {"double": "D", "bigint": "L"}.get(kind, "")
    quoted = [s.name.replace("\\", "\\\\").replace("'", "\\'") for s in sources]
    pairs = ", ".join(f"'{name}', {value(s)!r}{suffix}" for name, s in zip(quoted, sources, strict=True))
    return F.expr(f"element_at(map({pairs}), source)")


def _rate(sources: list[Source]) -> Column:
    """exp(tilt * tokens / mean), at most the repeats; the repeats themselves where all is wanted."""
    tilt = _by_source(sources, lambda s: s.tilt, "double")
    mean = _by_source(sources, lambda s: s.mean, "double")
    repeats = _by_source(sources, lambda s: s.repeats, "double")
    rate = F.least(repeats, F.exp(F.least(tilt * F.col("n_tokens") / mean, F.lit(_HIGHEST))))
    full = _by_source(sources, lambda s: s.wanted >= s.most, "boolean")
    none = _by_source(sources, lambda s: s.wanted <= 0, "boolean")
    return F.when(none, F.lit(0.0)).when(full, repeats).otherwise(rate)


def balance(lengths: DataFrame, sources: list[Source]) -> int:
    """Newton steps on the dual of each source's token constraint; sets the tilts, gives the steps made.

    ``lengths`` has ``source, n_tokens, n``. A step that leaves the bracket of the root halves it instead.
    """
    open_ones = {s.name: s for s in sources if 0 < s.wanted < s.most}
    low, high = dict.fromkeys(open_ones, -math.inf), dict.fromkeys(open_ones, math.inf)
    for step in range(STEPS):
        if not open_ones:
            return step
        active = [s for s in sources if s.name in open_ones]
        mean = _by_source(sources, lambda s: s.mean, "double")
        free = _rate(sources) < _by_source(sources, lambda s: s.repeats, "double")
        mass = F.col("n") * F.col("n_tokens") * F.col("rate")
        sums = {
            r["source"]: (r["reached"], r["slope"] or 0.0)
            for r in lengths.where(F.col("source").isin([s.name for s in active]))
            .withColumn("rate", _rate(sources))
            .groupBy("source")
            .agg(F.sum(mass).alias("reached"), F.sum(F.when(free, mass * F.col("n_tokens") / mean)).alias("slope"))
            .collect()
        }
        for s in active:
            reached, slope = sums[s.name]
            gap = s.wanted - reached
            if abs(gap) <= PRECISION * s.wanted:
                del open_ones[s.name]
                continue
            (low if gap > 0 else high)[s.name] = s.tilt
            a, b = low[s.name], high[s.name]
            step_to = s.tilt + max(-2.0, min(2.0, gap / slope)) if slope > 0 else (s.tilt + math.copysign(1.0, gap))
            if not a < step_to < b:
                step_to = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else s.tilt + math.copysign(1.0, gap)
            s.tilt = step_to
    return STEPS


@dataclass(frozen=True)
class Reach:
    """How far down the line of a source's documents its room goes: whole slots, then places within one slot."""

    slot: int
    place: int
    doc: int
    tokens: int


def _slot(place: Column) -> Column:
    return F.shiftright(place, BITS + 1 - (SLOTS.bit_length() - 1)).cast("int")


def _within(reach: dict[str, Reach], sources: list[Source], place: Column) -> Column:
    """Whether a document stands within its source's reach."""
    of = lambda name, kind: _by_source(sources, lambda s: getattr(reach.get(s.name, Reach(-1, -1, -1, 0)), name), kind)
    first = (place < of("place", "bigint")) | (place == of("place", "bigint")) & (F.col("doc_id") <= of("doc", "bigint"))
    return (_slot(place) < of("slot", "int")) | (_slot(place) == of("slot", "int")) & first


def reach_of(line: DataFrame, room: dict[str, float], sources: list[Source]) -> dict[str, Reach]:
    """How many documents of each source, taken in line, fit into its room: a running sum in two passes.

    ``line`` has ``doc_id, source, n_tokens, place``. The first pass sums tokens by slots of places, which says in which
    slot a source's room ends: ``SLOTS`` numbers a source at most, whatever the input. The second puts the documents
    of that one slot in order, where a window runs their sum; one row per source comes to the driver.
    """
    if not any(x > 0 for x in room.values()):
        return {}
    slots: dict[str, list[tuple[int, int]]] = {}
    for r in line.groupBy("source", _slot(F.col("place")).alias("slot")).agg(F.sum("n_tokens").alias("t")).collect():
        slots.setdefault(r["source"], []).append((r["slot"], r["t"]))
    found: dict[str, Reach] = {}
    for name, sums in slots.items():
        before, end = 0, SLOTS
        for slot, t in sorted(sums):
            if before + t > room.get(name, 0.0):
                end = slot
                break
            before += t
        found[name] = Reach(end, -1, -1, before)
    if all(r.slot == SLOTS for r in found.values()):
        return found
    of = lambda value, kind: _by_source(sources, value, kind)
    last = line.where(_slot(F.col("place")) == of(lambda s: found[s.name].slot if s.name in found else SLOTS, "int"))
    before = of(lambda s: found[s.name].tokens if s.name in found else 0, "bigint")
    running = before + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place", "doc_id"))
    fits = last.withColumn("running", running).where(F.col("running") <= of(lambda s: room.get(s.name, 0.0), "double"))
    for r in fits.groupBy("source").agg(F.max(F.struct("place", "doc_id")).alias("at"), F.max("running").alias("running")).collect():
        found[r["source"]] = Reach(found[r["source"]].slot, r["at"]["place"], r["at"]["doc_id"], r["running"])
    return found


def _place(claim: Column) -> Column:
    """A claim between 0 and 2 as an integer."""
    return F.least(F.floor(claim * float(1 << BITS)).cast("bigint"), F.lit((2 << BITS) - 1))


def _by_size(room: Column, *salt: str) -> Column:
    """A place in line by size against the room, the largest that fit first; about equal ones in order of a hash."""
    rank = F.floor((1.0 - F.least(F.col("n_tokens") / room, F.lit(1.0))) * float(SLOTS - 1))
    return _place((rank + _even(*salt)) * (2.0 / SLOTS))


def _even(*salt: str) -> Column:
    """A hash of the document's id, even between 0 and 1."""
    return F.pmod(F.xxhash64("doc_id", *[F.lit(x) for x in salt]), F.lit(1 << BITS)) / F.lit(float(1 << BITS))


def _shortest(left: dict[str, float], sources: list[Source]) -> dict[str, float]:
    """The room of the sources that are still short of their tokens by more than ``SHORT``."""
    return {s.name: left[s.name] for s in sources if left[s.name] > SHORT * s.wanted}


def _round_up(rated: DataFrame, sources: list[Source]) -> tuple[DataFrame, dict[str, float]]:
    """Marks as ``more`` the documents that get one copy more than the whole part of their rate; also the tokens then left.

    A document's claim is a hash of its id less the fraction of its rate, so each is rounded up about as often as the
    fraction says; documents stand in line by it. The first pass takes them until the next no longer fits, the second goes
    on without those that are too long; the few tokens then left are filled by further passes, the largest documents
    that fit first, which leave less than half each.
    """
    fraction = F.col("rate") - F.floor("rate")
    may = rated.where(fraction > 0)
    firm = {r["source"]: r["t"] for r in rated.groupBy("source").agg(F.sum(F.floor("rate") * F.col("n_tokens")).alias("t")).collect()}
    left = {s.name: max(0.0, s.wanted - (firm.get(s.name) or 0)) for s in sources}
    taken = F.lit(False)
    for n in range(PASSES):
        room = _shortest(left, sources)
        free = _by_source(sources, lambda s: room.get(s.name, -1.0), "double")  # noqa: B023  evaluated at once
        fits = F.col("n_tokens") <= free
        place = _place(_even() - fraction + 1.0) if n < 2 else _by_size(free, f"{n}")
        reach = reach_of(may.where(fits & ~taken).withColumn("place", place), room, sources)
        if not any(r.tokens for r in reach.values()):
            break
        taken = taken | fits & _within(reach, sources, place)
        for name, r in reach.items():
            left[name] -= r.tokens
    return rated.withColumn("more", (fraction > 0) & taken), left


def _top_up(copied: DataFrame, left: dict[str, float], sources: list[Source]) -> DataFrame:
    """Further copies, within the repeats, where rounding left a source short of its tokens.

    That happens where single documents hold much of a source, which one copy more or less misses by as much. Each
    pass adds a copy of the documents that still may be used and fit, in line of a hash; only these are written.
    """
    repeats = _by_source(sources, lambda s: s.repeats, "int")
    extra: DataFrame | None = None
    now = copied
    for n in range(PASSES):
        room = _shortest(left, sources)
        free = _by_source(sources, lambda s: room.get(s.name, -1.0), "double")  # noqa: B023  evaluated at once
        may = now.where((F.col("copies") < repeats) & (F.col("n_tokens") > 0) & (F.col("n_tokens") <= free))
        line = may.withColumn("place", _by_size(free, f"more{n}"))
        reach = reach_of(line, room, sources)
        if not any(r.tokens for r in reach.values()):
            break
        own = line.where(_within(reach, sources, F.col("place"))).select("doc_id", F.lit(1).alias("further"))
        both = own if extra is None else extra.unionByName(own).groupBy("doc_id").agg(F.sum("further").cast("int").alias("further"))
        extra = durable(both)
        now = copied.join(broadcast_if_small(extra), "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("further", F.lit(0))).select(*copied.columns)
        for name, r in reach.items():
            left[name] -= r.tokens
    return now


def mix(tokens: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[Source]]:
    """``doc_id, source, n_tokens, rate, copies`` of every document of the targets' sources, and the sources.

    ``tokens`` has ``doc_id, source, n_tokens``. Sources are spelled exactly; documents of other or no
    sources take no part; a document without tokens has 0 copies. Copies never exceed the repeats. Per
    source the tokens of all copies never exceed what is wanted and fall short of it by less than
    ``SHORT``, unless no document that may still be used is short enough. What comes to the driver is a fixed number
    of sums per source, however many documents or lengths it has.
    """
    sources = read_targets(targets)
    known = tokens.where(F.col("source").isin([s.name for s in sources])) if sources else tokens.limit(0)
    known = durable(known.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")))
    if not sources:
        return known.select("*", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")), sources
    lengths = durable(known.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    by = {s.name: s for s in sources}
    for r in lengths.groupBy("source").agg(F.sum("n").alias("d"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect():
        by[r["source"]].documents, by[r["source"]].tokens = r["d"], r["t"]
    fill_targets(sources)
    balance(lengths, sources)
    rated = known.withColumn("rate", F.when(F.col("n_tokens") > 0, _rate(sources)).otherwise(F.lit(0.0)))
    line, left = _round_up(rated, sources)
    copied = durable(line.withColumn("copies", (F.floor("rate") + F.when(F.col("more"), 1).otherwise(0)).cast("int")).drop("more"))
    return _top_up(copied, left, sources), sources


def reached_shares(mixture: DataFrame, targets: DataFrame, sources: list[Source]) -> DataFrame:
    """Per target source: wanted and reached shares of all tokens, tokens and documents at hand and used."""
    used = mixture.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"),
        F.count_if(F.col("copies") > 0).alias("documents_used"),
        F.max("copies").alias("most_copies"),
        F.sum("n_tokens").alias("tokens_at_hand"),
    )
    spark = mixture.sparkSession
    wanted = spark.createDataFrame([(s.name, float(s.share), s.repeats, float(s.wanted)) for s in sources], "source string, target_share double, max_repeats int, tokens_wanted double")
    joined = wanted.join(used, "source", "left")
    total = used.agg(F.sum("tokens_used").alias("t")).scalar()
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        "tokens_wanted",
        F.coalesce("tokens_at_hand", zero).alias("tokens_at_hand"),
        F.coalesce("tokens_used", zero).alias("tokens_used"),
        F.coalesce("documents_used", zero).alias("documents_used"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide(F.coalesce("tokens_used", zero).cast("double"), total), F.lit(0.0)).alias("actual_share"),
    )
