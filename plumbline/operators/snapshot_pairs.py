"""Which snapshot each snapshot is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.blocked import blocked_neighbours


def consecutive_snapshots(snapshots: DataFrame) -> DataFrame:
    """``head_snapshot_id, base_snapshot_id`` for each snapshot that has an earlier one.

    Redelivered snapshots count once. Rows without id, solution or time take no part.
    """
    once = (
        snapshots.select("snapshot_id", "solution_path", "analyzed_at")
        .where("snapshot_id is not null and solution_path is not null and analyzed_at is not null")
        .groupBy("snapshot_id")
        .agg(F.min(F.struct("analyzed_at", "solution_path")).alias("s"))
        .select("snapshot_id", "s.solution_path", "s.analyzed_at")
        .withColumn("at", F.struct("analyzed_at", "snapshot_id"))
    )
    month = F.floor(F.datediff("analyzed_at", F.lit("1970-01-01").cast("date")) / F.lit(30)).cast("long")
    return (
        blocked_neighbours(once, ["solution_path"], "at", ["snapshot_id"], month)
        .where(F.col("prev.snapshot_id").isNotNull())
        .select(F.col("snapshot_id").alias("head_snapshot_id"), F.col("prev.snapshot_id").alias("base_snapshot_id"))
    )


def snapshot_roles(pairs: DataFrame) -> DataFrame:
    """``snapshot_id, pair, sign``: a snapshot is +1 in its own pair and -1 in the next one's."""
    return pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("head_snapshot_id").alias("snapshot_id"), F.col("head_snapshot_id").alias("pair"), F.lit(1).alias("sign")),
                F.struct(F.col("base_snapshot_id").alias("snapshot_id"), F.col("head_snapshot_id").alias("pair"), F.lit(-1).alias("sign")),
            )
        )
    )
