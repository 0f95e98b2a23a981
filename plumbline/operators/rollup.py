"""Rollups method -> type -> namespace -> project -> snapshot, and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.metrics import namespace_of

#: Indices are summed in fixed point, so that a sum does not depend on the order of its rows.
EXACT = "decimal(28,10)"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _measures() -> list[Column]:
    """Sums of methods; no methods give 0 and an average of 0."""
    return [
        _zero(F.sum("n_methods")).alias("method_count"),
        _zero(F.sum("cc")).alias("total_cc"),
        _zero(F.sum("loc")).alias("total_loc"),
        F.coalesce(F.sum("mi_sum").cast("double") / F.nullif(F.sum("mi_n"), F.lit(0)), F.lit(0.0)).alias("avg_mi"),
    ]


def type_rollup(types: DataFrame, methods: DataFrame) -> DataFrame:
    """One row per type with its method sums; types without methods keep zeros.

    Methods are summed by type before the join, so a type with many methods moves as one row.
    """
    per = methods.where("type_id is not null").groupBy("type_id").agg(
        F.count(F.lit(1)).alias("n_methods"), F.sum("cyclomatic_complexity").alias("cc"), F.sum("lines_of_executable_code").alias("loc"), F.sum(F.col("maintainability_index").cast(EXACT)).alias("mi_sum"), F.count("maintainability_index").alias("mi_n")
    )
    joined = types.join(per, "type_id", "left")
    filled = joined.na.fill(0, ["n_methods", "cc", "loc", "mi_n"])
    return filled.withColumn("mi_sum", F.coalesce("mi_sum", F.lit(0).cast(EXACT))).withColumn("namespace", namespace_of("full_name"))


def namespace_rollup(per_type: DataFrame, across_projects: bool = False) -> DataFrame:
    """Per namespace of a project, or of a snapshot across its projects; the average weighs methods."""
    keys = ["snapshot_id", *([] if across_projects else ["project"]), "namespace"]
    return per_type.groupBy(*keys).agg(F.count(F.lit(1)).alias("type_count"), *_measures(), _zero(F.max("depth_of_inheritance")).alias("max_dit"))


def project_rollup(per_type: DataFrame) -> DataFrame:
    """Per project, those of missing name among them; the average weighs methods."""
    return per_type.groupBy("snapshot_id", "project").agg(F.count(F.lit(1)).alias("type_count"), *_measures(), _zero(F.max("depth_of_inheritance")).alias("max_dit"))


def hierarchy(per_type: DataFrame) -> DataFrame:
    """Every level at once: snapshot, project and namespace rows with their ``level``."""
    g = per_type.rollup("snapshot_id", "project", "namespace").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("type_count"), *_measures(), _zero(F.max("depth_of_inheritance")).alias("max_dit"))
    level = F.when(F.col("g") == 0, "namespace").when(F.col("g") == 1, "project").when(F.col("g") == 3, "snapshot").otherwise("all")
    return g.withColumn("level", level).drop("g")


def top_methods(methods: DataFrame, measure: str, keep: Column, descending: bool, n: int = 5) -> DataFrame:
    """The first ``n`` methods of each project by a measure, ties by name and id."""
    order = F.col(measure).desc() if descending else F.col(measure).asc()
    w = Window.partitionBy("snapshot_id", "project").orderBy(order, "full_name", "method_id")
    return methods.where(keep).withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def overflow(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with the number of those that follow."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy(*order).limit(n).withColumn("more", F.greatest(total - F.lit(n), F.lit(0)))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """One page, counted from 1, of an ordered listing."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def contains_anywhere(columns: list[str], text: str) -> Column:
    """Whether any column, as text and without regard to case, contains ``text``."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return found


def mixed_order(column: str) -> list[Column]:
    """Numbers by value before texts by binary order."""
    number = F.expr(f"try_cast({column} as double)")
    return [number.asc_nulls_last(), F.col(column).asc()]
