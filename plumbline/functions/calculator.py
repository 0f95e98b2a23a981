"""The measures of a method behind one object, each of which a caller may replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn


class Calculator:
    """Six measures as column expressions over the counts of a lexed body.

    A subclass that overrides one changes what ``measured`` gives for it and for all that is computed from it. The
    counts are columns ``branches, statements, n1, n2, total1, total2, depth, has_body, is_expression``.
    """

    def complexity(self) -> Column:
        return F.col("branches") + 1

    def lines(self) -> Column:
        return F.col("statements")

    def volume(self) -> Column:
        return fn.halstead_volume("n1", "n2", "total1", "total2")

    def effort(self) -> Column:
        return fn.halstead_effort("n1", "n2", "total1", "total2")

    def depth(self) -> Column:
        return F.coalesce(F.col("depth"), F.lit(0))

    def maintainability(self, volume: Column, complexity: Column, lines: Column) -> Column:
        return fn.maintainability_index(volume, complexity, lines)

    def measured(self, bodies: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and the measures of each body; one without a body has fixed ones, as ``body_measures`` says."""
        raw = bodies.select("*", self.complexity().alias("_complexity"), self.lines().alias("_lines"), self.volume().alias("_volume"), self.effort().alias("effort"), self.depth().alias("_depth"))
        plain = fn.body_measures("has_body", "is_expression", "_complexity", "_lines", "_volume")
        index = F.when(F.col("has_body"), self.maintainability(F.col("_volume"), F.col("_complexity"), F.col("_lines"))).otherwise(100.0)
        return raw.select(*keep, plain["complexity"].alias("complexity"), plain["lines"].alias("lines"), plain["volume"].alias("volume"), index.alias("maintainability"), F.when(F.col("has_body"), F.col("effort")).otherwise(0.0).alias("effort"), F.col("_depth").alias("depth"))
