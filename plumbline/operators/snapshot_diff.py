"""What changed between consecutive full snapshots, by signed cells.

Both snapshots of a pair are unpivoted into cells (key, field, value) signed +1 for the newer and -1
for the older, with one presence marker per key. Equal cells cancel in a grouped sum, so what is not
zero is what changed: a presence of +1 is an added key, -1 a removed one, and a key that is present on
both sides with a field cell left over is a changed one. Partial aggregation cancels most cells before
they are shuffled, and no row is ever compared with another.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.blocked import blocked_rank, int_block
from plumbline.session import broadcast_if_small, distinct_by, durable, ship

_PRESENT = -1


def fold(column: str) -> Column:
    """Text as it is compared: without regard to case, null apart from every string."""
    return F.coalesce(F.lower(F.col(column).cast("string")), F.lit("\u0000"))


def identity(columns: list[str], tag: str) -> tuple[Column, Column]:
    """128 bits that stand for the folded values of ``columns``."""
    parts = [fold(c) for c in columns]
    return F.xxhash64(F.lit(tag), *parts), F.xxhash64(F.lit(tag + "2"), *parts)


def keyed_cells(rows: DataFrame, roles: DataFrame, snapshot: str, key: Column, row_id: str, fields: list[str]) -> DataFrame:
    """Signed cells ``pair, key, field, value, sign, row_id`` of rows with a natural key.

    ``key`` is a hash of it; the key itself is the value of the presence marker, which is field -1, and the others are
    numbered as in ``fields``. A key that occurs several times in one snapshot is represented by its smallest
    ``row_id``, which makes repeated deliveries count once. Null fields read as 0.
    """
    own = [F.col(row_id).alias("_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("0")).alias(f) for f in fields]]
    once = rows.groupBy(F.col(snapshot).alias("snapshot_id"), key.alias("key")).agg(F.min(F.struct(*own)).alias("r"))
    cell = lambda number, value: F.struct(F.lit(number).cast("tinyint").alias("field"), value.alias("value"))
    cells = F.array(cell(_PRESENT, F.col("key")), *[cell(i, F.col(f"r.{f}")) for i, f in enumerate(fields)])
    return once.join(broadcast_if_small(roles), "snapshot_id").select("pair", F.xxhash64("key").alias("key"), "sign", F.col("r._id").alias("row_id"), F.inline(cells))


def settle_cells(cells: DataFrame, fields: list[str]) -> DataFrame:
    """``pair, key, base_key, head_key, outcome, changed_fields`` of every key that changed.

    ``outcome`` is added, removed or changed; a missing row id is -1; ``changed_fields`` is sorted and
    empty unless the outcome is changed. Two equal snapshots give no rows.
    """
    present = F.col("field") == _PRESENT
    netted = (
        cells.groupBy("pair", "key", "field", "value")
        .agg(
            F.sum("sign").alias("net"),
            F.min(F.when(present & (F.col("sign") < 0), F.col("row_id"))).alias("base_id"),
            F.min(F.when(present & (F.col("sign") > 0), F.col("row_id"))).alias("head_id"),
        )
        .where((F.col("net") != 0) | present)
    )
    names = F.array(*[F.lit(f) for f in fields])
    per_key = netted.groupBy("pair", "key").agg(
        F.max(F.when(present, F.col("net"))).alias("presence"),
        F.max(F.when(present, F.col("value"))).alias("name"),
        F.min("base_id").alias("base_id"),
        F.min("head_id").alias("head_id"),
        F.array_sort(F.collect_set(F.when(~present, F.element_at(names, F.col("field") + 1)))).alias("fields"),
    )
    outcome = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").when(F.size("fields") > 0, "changed")
    minus = F.lit(-1).cast("bigint")
    return per_key.withColumn("outcome", outcome).where("outcome is not null").select(
        "pair",
        F.col("name").alias("key"),
        F.coalesce("base_id", minus).alias("base_key"),
        F.coalesce("head_id", minus).alias("head_key"),
        "outcome",
        F.when(F.col("outcome") == "changed", F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )


class _Nearest:
    """The rows of one side that are still free, looked up by least distance in line, then column."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.lines: list[int] = []
        self.at: dict[int, list[tuple[int, int]]] = {}
        for line, col, pos in sorted(rows):
            if line not in self.at:
                self.lines.append(line)
                self.at[line] = []
            self.at[line].append((col, pos))

    def take(self, line: int, col: int) -> int | None:
        """Claim the nearest free row and give its position."""
        if not self.lines:
            return None
        i = bisect_left(self.lines, line)
        near = self.lines[max(0, i - 1) : i + 1]
        least = min(abs(x - line) for x in near)
        best = None
        for x in near:
            if abs(x - line) != least:
                continue
            free = self.at[x]
            j = bisect_left(free, (col,))
            options = [j] if j < len(free) else []
            if j:  # the smallest position of the next lower column comes first within it
                options.append(bisect_left(free, (free[j - 1][0],)))
            for k in options:
                c, pos = free[k]
                rank = (abs(c - col), x, c, pos)
                if best is None or rank < best[0]:
                    best = (rank, x, k)
        _, x, k = best
        free = self.at[x]
        pos = free.pop(k)[1]
        if not free:
            del self.at[x]
            self.lines.pop(bisect_left(self.lines, x))
        return pos

    def left(self) -> list[int]:
        return [pos for free in self.at.values() for _, pos in free]


def pair_nearest(base: list[tuple[int, int, int]], head: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Greedy pairs (base position, head position), -1 for none; rows are (position, line, column).

    Base rows go in the order of their position; each claims the free head row with the least
    distance in line, then in column, then the smallest line, column and position.
    """
    if not head:
        return [(pos, -1) for pos, _, _ in base]
    free = _Nearest([(line, col, pos) for pos, line, col in head])
    out = []
    for pos, line, col in sorted(base):
        taken = free.take(line, col)
        out.append((pos, -1 if taken is None else taken))
    out.extend((-1, pos) for pos in free.left())
    return out


#: Fields of a finding that may change while it stays the same finding.
PLACE = ("line", "col_no")
SETTLED = "pair string, base_key bigint, head_key bigint, outcome string, changed_fields array<string>"


def settle_slot(base: list[int | None] | None, head: list[int | None] | None) -> tuple[str, list[str]]:
    """Outcome and changed fields of one slot by its cells' signed sums; a side is the values of ``PLACE``, or None.

    A slot is a key that one row of each side at most holds. Its presence marker and the cell of each value are summed,
    +1 for the newer and -1 for the older row.
    """
    sums: Counter = Counter()
    for sign, row in ((-1, base), (1, head)):
        if row is not None:
            sums[_PRESENT, None] += sign
            for field, value in zip(PLACE, row, strict=True):
                sums[field, value] += sign
    presence = sums[_PRESENT, None]
    if presence:
        return ("added" if presence > 0 else "removed"), []
    return "changed", sorted({field for (field, _), net in sums.items() if net})


def _settle_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over leftover rows sorted by pair and key: one group is held at a time, as numbers only."""
    group, base, head = None, [], []
    rows: list[tuple] = []

    def close() -> None:
        at = [{pos: place for pos, *place in side} for side in (base, head)]
        known = [[(pos, line or 0, col or 0) for pos, line, col in side] for side in (base, head)]
        rows.extend((group[0], b, h, *settle_slot(at[0].get(b), at[1].get(h))) for b, h in pair_nearest(*known))

    def flush() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SETTLED.split(", ")])
        rows.clear()
        return out

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("pair", "ka", "kb", "sign", "pos", "line", "col")]
        for pair, ka, kb, sign, pos, line, col in zip(*columns, strict=True):
            if (pair, ka, kb) != group:
                if group is not None:
                    close()
                group, base, head = (pair, ka, kb), [], []
            (head if sign > 0 else base).append((pos, line, col))
        if len(rows) > 20_000:
            yield flush()
    if group is not None:
        close()
    if rows:
        yield flush()


def surplus_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no equal row of the other side cancels, equal rows pairing off in the order of ``pos``.

    ``rows`` has ``keys``, ``sign`` and ``pos``. The signed presence markers of a key are summed map-side before
    anything is written; what is left over of a key are the last rows of the side with the surplus. Where these are
    more than the ends of the side say, its rows are ranked, in blocks.
    """
    at = lambda s: F.when(F.col("sign") == s, F.col("pos"))
    ends = [f(at(s)).alias(f"_{n}{s}") for s in (-1, 1) for f, n in ((F.max, "last"), (F.min, "first"))]
    net = durable(rows.groupBy(*keys).agg(F.sum("sign").alias("net"), F.count(F.lit(1)).alias("n"), *ends).where("net != 0"))
    side = lambda n: F.when(F.col("net") > 0, F.col(f"_{n}1")).otherwise(F.col(f"_{n}-1"))
    spare, alone = F.abs("net"), F.abs("net") == F.col("n")
    known = (spare == 1) | (spare == 2) & alone
    pos = F.when(spare == 1, F.array(side("last"))).otherwise(F.array(side("first"), side("last")))
    one = net.where(known).select(*keys, F.signum("net").cast("int").alias("sign"), F.explode(pos).alias("pos"))
    several = net.where(~known).select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.signum("net").cast("int").alias("_side"), spare.alias("_spare"))
    if several.isEmpty():
        return one
    on = F.col("sign") == F.col("_side")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    own = durable(rows.join(broadcast_if_small(durable(several)), on).select(*keys, "sign", "pos", "_spare", (-F.col("pos")).alias("_back")))
    ranked = blocked_rank(own, [*keys, "sign"], "_back", int_block("_back"), "_rank").where("_rank <= _spare")
    return one.unionByName(ranked.select(*keys, "sign", "pos"))


def diagnostic_cells(items: DataFrame, roles: DataFrame) -> DataFrame:
    """Signed presence markers ``pair, ka, kb, line, col, sign, pos`` of diagnostics, one per row and pair of its snapshot.

    The key is the whole row without its position: ``ka`` and ``kb`` stand for project, id, severity, message and file,
    which say whether two findings are the same. Rows without snapshot or position take no part; of several
    deliveries of a (snapshot, position) the latest counts.
    """
    text = ["project", "id", "severity", "message", "file"]
    latest = ["loaded_at"] if "loaded_at" in items.columns else []
    known = items.where("snapshot_id is not null and pos is not null").select("snapshot_id", F.col("pos").cast("bigint").alias("pos"), *text, "line", "col_no", *latest)
    once = distinct_by(known, ["snapshot_id", "pos"], *latest)
    ka, kb = identity(text, "d")
    narrow = once.select("snapshot_id", "pos", ka.alias("ka"), kb.alias("kb"), F.col("line").cast("int").alias("line"), F.col("col_no").cast("int").alias("col"))
    return narrow.join(broadcast_if_small(roles), "snapshot_id").select("pair", "ka", "kb", "line", "col", "sign", "pos")


def diagnostic_changes(items: DataFrame, roles: DataFrame) -> DataFrame:
    """``pair, base_key, head_key, outcome, changed_fields`` of diagnostics; keys are positions, -1 for none.

    Presence markers of whole rows cancel first. What is left pairs within project, id, severity, message and file by
    ``pair_nearest``, which gives each leftover row its slot; the cells of a slot say what became of it and which of line
    and column changed. A missing line or column differs from 0, but reads as 0 in distances.
    """
    ship(items.sparkSession)
    left = surplus_rows(diagnostic_cells(items, roles), ["pair", "ka", "kb", "line", "col"])
    ordered = left.select("pair", "ka", "kb", "sign", "pos", "line", "col").repartition("pair", "ka", "kb").sortWithinPartitions("pair", "ka", "kb")
    return ordered.mapInArrow(_settle_moves, SETTLED)


#: Fields by which projects are compared.
PROJECT_FIELDS = ["type_count", "method_count", "total_cc", "total_loc"]


def project_changes(projects: DataFrame, roles: DataFrame) -> DataFrame:
    """``settle_cells`` of project_metrics: the key is the project's name without regard to case."""
    named = projects.where("snapshot_id is not null")
    return settle_cells(keyed_cells(named, roles, "snapshot_id", F.lower("project_name"), "project_row_id", PROJECT_FIELDS), PROJECT_FIELDS)


__all__ = ["diagnostic_cells", "diagnostic_changes", "keyed_cells", "pair_nearest", "project_changes", "settle_cells", "settle_slot", "surplus_rows"]
