"""Window functions over one long ordered group, worked in blocks.

A plain window puts each group into one task. Here a group is cut into blocks by its order column;
the window runs within a block, and one row per block is enough to carry state from block to block.
A group that holds a third of all rows so becomes many bounded tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def int_block(order: str, width: int = 4096) -> Column:
    """Block number of an integer order column."""
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def blocked_neighbours(df: DataFrame, keys: list[str], order: str, values: list[str], block: Column, forward: bool = False) -> DataFrame:
    """Add ``prev`` (or ``next``): a struct of ``values`` from the row before (after) in the group.

    ``order`` must be unique within a group and not null. The first (last) row of a group gets a
    null struct. Null keys form a group of their own. ``df`` is read twice; cut its lineage
    first if it is costly.
    """
    name = "next" if forward else "prev"
    rows = df.withColumn("_block", block)
    cols = [*keys, "_block"]
    direction = F.col(order).desc() if forward else F.col(order).asc()
    inner = Window.partitionBy(*cols).orderBy(direction)
    outer = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if forward else F.col("_block").asc())
    pick = F.min_by if forward else F.max_by
    carried = (
        rows.groupBy(*cols)
        .agg(pick(F.struct(*values), F.col(order)).alias("_end"))
        .withColumn("_carried", F.lag("_end").over(outer))
        .select(*[F.col(c).alias(f"_k_{c}") for c in cols], "_carried")
    )
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cols]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return (
        rows.withColumn("_within", F.lag(F.struct(*values)).over(inner))
        .join(carried, on, "left")
        .withColumn(name, F.coalesce("_within", "_carried"))
        .drop("_block", "_within", "_carried", *[f"_k_{c}" for c in cols])
    )


def blocked_rank(df: DataFrame, keys: list[str], order: str, block: Column, name: str = "rank_no") -> DataFrame:
    """Add a row number (from 1) by ``order`` within ``keys``, without one task per group."""
    rows = df.withColumn("_block", block)
    cols = [*keys, "_block"]
    inner = Window.partitionBy(*cols).orderBy(order)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
        .select(*[F.col(c).alias(f"_k_{c}") for c in cols], "_before")
    )
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return (
        rows.withColumn("_in", F.row_number().over(inner))
        .join(before, on)
        .withColumn(name, (F.col("_in") + F.col("_before")).cast("long"))
        .drop("_block", "_in", "_before", *[f"_k_{c}" for c in cols])
    )
