"""The best N items of every group by secondary sort.

Rows are sorted by the engine, which spills, and streamed in Arrow batches; the worker keeps only the
current group's name and the items it has emitted. A first pass over the unshuffled input splits
leaves at most N rows per group and split, so the shuffle by group carries no hot group's bulk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship


def _starts(keys: pa.Array, before: object) -> np.ndarray:
    """Positions at which the key differs from the row before; ``before`` is the last key so far."""
    n = len(keys)
    differs = np.ones(n, bool)
    if n > 1:
        differs[1:] = ~pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    differs[0] = keys[0].as_py() != before
    return np.flatnonzero(differs)


def _stream(n: int, ranked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("group"), batch.column("item")
            picks, ranks = [], []
            starts = _starts(keys, group)
            bounds = [0, *starts.tolist(), batch.num_rows]
            for k in range(len(bounds) - 1):
                begin, end = bounds[k], bounds[k + 1]
                if k > 0:
                    taken = []
                i = begin
                while i < end and len(taken) < n:
                    item = ids[i].as_py()
                    if item not in taken:
                        taken.append(item)
                        picks.append(i)
                        ranks.append(len(taken))
                    i += 1
            group = keys[batch.num_rows - 1].as_py()
            if picks:
                out = batch.take(pa.array(picks))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ranks, pa.int32())], [*out.schema.names, "rank_no"]) if ranked else out

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, order: list[Column], n: int, order_types: list[str]) -> DataFrame:
    """``group, rank_no, item`` of the first ``n`` distinct items of each group.

    ``order`` are sort expressions over ``df`` whose ties must end at ``item``; they are computed once as
    columns of ``order_types`` and sorted ascending. The null group gives no rows; an item is
    ranked at its best place; groups with fewer items give fewer rows; nulls in the order sort first.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    names = [f"o{i}" for i in range(len(order))]
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(item).alias("item"), *[c.alias(o) for c, o in zip(order, names, strict=True)])
    schema = ", ".join([f"group {kinds[group]}", f"item {kinds[item]}", *[f"{o} {t}" for o, t in zip(names, order_types, strict=True)]])
    by = ["group", *names, "item"]
    local = rows.sortWithinPartitions(*by).mapInArrow(_stream(n, False), schema)
    best = local.repartition("group").sortWithinPartitions(*by).mapInArrow(_stream(n, True), schema + ", rank_no int")
    return best.select(F.col("group").alias(group), "rank_no", F.col("item").alias(item))
